"""Quality rules: an ordered decision list learned from labelled statistics, applied as Spark conditions.

Sequential covering: a rule is a conjunction of thresholds grown by information gain on two thirds of the
labelled sample and pruned on the last third; the documents that it covers leave the sample, and the next
rule is grown on the rest, until a rule is no better than its precision bound. Rules reject; what none of
them covers is kept. A document counts as bad if its label has quality 0 or toxic 1.

The sample holds LABELLED_ROWS labelled documents at most (those of the smallest id hashes; of several rows with one id, the one of the smallest
statistics). Statistics are of whole texts, and the rules run over all documents.

Defined results: a null text has no words and fails the base rule; repeated rows are judged each; documents
with several labels are bad if one says so; without labels of both kinds the list is empty and the base
rule alone decides; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm import common

LABELLED_ROWS = 20_000
#: Words of the learned lexicon: in so many toxic documents and this share of them at least, and in others for this share at most.
LEXICON_DOCS, LEXICON_SHARE, LEXICON_OTHER, LEXICON_WORDS = 5, 0.01, 0.02, 1000
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_CONDITIONS, CUTS = 0.95, 5, 20, 4, 64
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_PUNCT = b".,;:!?"
_SPACE = b" \t\n\r\x0b\x0c"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_punct long, n_top_word long, n_distinct long, n_flagged long"
_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def count_text(text: bytes | None, lexicon: frozenset[bytes]) -> tuple[int, ...]:
    """The counts of COUNTS for one whole text."""
    words = common.spaced_words(text)
    n = len(words)
    if not n:
        return (0,) * 2 + (len(text) - len(text.translate(None, _SYMBOLS)) if text else 0,) + (0,) * 9
    solid = text.translate(None, _SPACE)
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    h = common.word_hashes(words)
    repeat = 0
    if n > 3:
        tri = common.window_hashes(h, 3)
        order = np.argsort(tri)
        same = tri[order][1:] == tri[order][:-1]
        if same.any():
            twice = np.zeros(len(tri), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : k + len(tri)] |= twice
            repeat = int(cover.sum())
    counts = np.unique(h, return_counts=True)[1]
    flagged = sum(map(lexicon.__contains__, common.plain_words(text))) if lexicon else 0
    less = lambda drop: len(solid) - len(solid.translate(None, drop))
    return n, len(solid.decode("utf-8", "replace")), less(_SYMBOLS), dup, repeat, lines, less(_UPPER), less(_DIGIT), less(_PUNCT), int(counts.max()), len(counts), flagged


def add_counts(docs: DataFrame, lexicon: frozenset[bytes] = frozenset()) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [count_text(t, lexicon) for t in b["text"]]
            yield dict(zip(_NAMES, (list(c) for c in zip(*rows, strict=True)) if rows else ([] for _ in _NAMES), strict=True))

    return common.append_columns(docs, ["text"], run, COUNTS)


def ratios() -> dict[str, F.Column]:
    """The statistics that rules may test: ratios of the counts, 0 for a text without words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "punct_per_word": F.col("n_punct") / n,
        "lines_per_word": F.col("n_lines") / n,
        "top_word_share": F.col("n_top_word") / n,
        "distinct_share": F.col("n_distinct") / n,
        "flagged_share": F.col("n_flagged") / n,
        "n_flagged": F.col("n_flagged").cast("double"),
        "n_words": F.col("n_words").cast("double"),
    }


Condition = tuple[str, str, float]


def _holds(x: np.ndarray, names: list[str], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        out &= v >= cut if op == ">=" else v <= cut
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], barred: set[tuple[str, str]]) -> list[Condition]:
    """Add the condition of the highest information gain until no clean row is covered; the first one is none of `barred` (statistic, side)."""
    rule: list[Condition] = []
    on = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~y[on]).any():
        p0, n0 = y[on].sum(), (~y[on]).sum()
        best: tuple[float, Condition] | None = None
        for k, name in enumerate(names):
            v = x[on, k]
            cuts = [np.quantile(part, np.linspace(0, 1, CUTS), method="higher") for part in (v, v[y[on]])]
            for cut in np.unique(np.concatenate(cuts)):
                for op, got in ((">=", v >= cut), ("<=", v <= cut)):
                    if not rule and (name, op) in barred:
                        continue
                    p, n = y[on][got].sum(), (~y[on])[got].sum()
                    if p >= MIN_COVER and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > (best[0] if best else 1e-9):
                        best = gain, (name, op, float(cut))
        if best is None:
            break
        rule.append(best[1])
        on &= _holds(x, names, rule[-1:])
    return rule


def _prune(x: np.ndarray, y: np.ndarray, names: list[str], rule: list[Condition]) -> list[Condition]:
    """The shortest beginning of the rule with the best (p - n) / (p + n) on the pruning rows."""
    def worth(k: int) -> float:
        got = _holds(x, names, rule[:k])
        p, n = y[got].sum(), (~y[got]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[list[Condition]]:
    """An ordered list of rejecting rules. Rows come in a fixed order; each third one prunes."""
    third = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~third], bad[~third], x[third], bad[third]
    rules: list[list[Condition]] = []
    barred: set[tuple[str, str]] = set()  # starts that led to no good rule on the rows that are left
    while len(rules) < MAX_RULES and gy.sum() >= MIN_COVER:
        grown = _grow(gx, gy, names, barred)
        if not grown:
            break
        rule = _prune(px, py, names, grown)
        got, gp = _holds(px, names, rule), _holds(gx, names, rule)
        p, n = py[got].sum() + gy[gp].sum(), (~py[got]).sum() + (~gy[gp]).sum()
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            barred.add(grown[0][:2])
            continue
        rules.append(rule)
        barred.clear()
        gx, gy, px, py = gx[~gp], gy[~gp], px[~got], py[~got]
    return rules


def verdict(rules: list[list[Condition]]) -> F.Column:
    """The decision list as one conditional expression: the number of the first rule that holds, else null."""
    stats = ratios()
    test = lambda c: stats[c[0]] >= c[2] if c[1] == ">=" else stats[c[0]] <= c[2]
    out = None
    for k, rule in enumerate(rules):
        whole = reduce(lambda a, b: a & b, map(test, rule))
        out = F.when(whole, F.lit(k)) if out is None else out.when(whole, F.lit(k))
    return (F.lit(None) if out is None else out).cast("int")


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> tuple[frozenset[bytes], list[list[Condition]]]:
    """Lexicon and rules from a bounded sample of labelled documents."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1))).alias("bad"), F.max(F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("tox")).filter("bad is not null")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = common.pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")  # `most` rows of three small columns

    def words(batches):
        for b in batches:
            got = Counter()
            for text, tox in zip(b["text"], b["tox"], strict=True):
                got.update((w, tox) for w in set(common.plain_words(text)))
            yield {"word": [k[0] for k in got], "tox": [k[1] for k in got], "n": list(got.values())}

    least = max(LEXICON_DOCS, LEXICON_SHARE * sample.filter("tox").count())
    flagged = (
        common.map_columns(rows.select(common.bytes_of("text").alias("text"), "tox"), words, "word binary, tox boolean, n long")
        .groupBy("word").agg(F.sum(F.when(F.col("tox"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("tox"), 0).otherwise(F.col("n"))).alias("o"))
        .filter((F.col("p") >= least) & (F.col("o") <= LEXICON_OTHER * F.col("p"))).orderBy(F.desc("p"), "word").limit(LEXICON_WORDS)
    )
    lexicon = frozenset(bytes(r.word) for r in flagged.collect())
    stats = ratios()
    got = add_counts(rows.select("doc_id", "text", "bad"), lexicon).filter(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    got = got.groupBy("doc_id").agg(F.min(F.struct(*[c.alias(f"s_{k}") for k, c in stats.items()])).alias("s"), F.first("bad").alias("bad")).select("doc_id", "bad", "s.*")
    pdf = got.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()  # `most` rows
    x, bad = pdf[[f"s_{k}" for k in stats]].to_numpy(float), pdf["bad"].to_numpy(bool)
    return lexicon, learn_rules(x, bad, list(stats))


def _judged(counted: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id and text with counts, base_failed, rule (number of the rule that rejects) and kept."""
    lexicon, rules = learn(docs, labels)
    return _judged(add_counts(common.pick(docs, "doc_id", "text"), lexicon), rules)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents with the columns of docs, whatever their names."""
    lexicon, rules = learn(docs, labels)
    inner = docs.toDF(*[f"lq_{i}" for i in range(len(docs.columns))]).withColumnRenamed(f"lq_{docs.columns.index('text')}", "text")
    kept = _judged(add_counts(inner, lexicon), rules).filter("kept")
    return kept.select(*inner.columns).toDF(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
