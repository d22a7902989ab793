"""Whole container files from words, for fixtures, round trips and sinks."""

from __future__ import annotations

from leafquarry.formats import iff, payloads

LINE_WORDS, PAGE_LINES, PITCH, LEADING = 8, 40, 100, 20


def page_layer(words: list[str]) -> tuple[str, payloads.Zone]:
    """Text and zones of a page: LINE_WORDS words to a line, a space after each word, boxes on a fixed grid."""
    text = " ".join(words)
    page = payloads.Zone("Page", 0, 0, LINE_WORDS * PITCH, PAGE_LINES * LEADING, 0, len(text.encode()))
    at = 0
    for k in range(0, len(words), LINE_WORDS):
        part, y = words[k : k + LINE_WORDS], k // LINE_WORDS * LEADING
        line = payloads.Zone("Line", 0, y, LINE_WORDS * PITCH, 16, at, 0)
        for j, w in enumerate(part):
            n = len(w.encode())
            line.children.append(payloads.Zone("Word", j * PITCH, y, 8 * min(len(w), 4000), 16, at, n))
            at += n + 1
        line.length = at - 1 - line.start
        page.children.append(line)
    return text, page


def document(words: list[str], outline: list[tuple] | None = None, notes: str = "", n_thumbnails: int = 0, layer: str = "TXTa") -> bytes:
    """A bundled document: directory, outline, a shared form with notes, pages with text layers, a form with thumbnails."""
    size = LINE_WORDS * PAGE_LINES
    parts = [words[k : k + size] for k in range(0, len(words), size)]
    forms = [("include", "shared.iff", iff.form("DJVI", [iff.chunk("ANTa", notes.encode())]))]
    for n, part in enumerate(parts, 1):
        text, zones = page_layer(part)
        body = payloads.text_layer(text, zones)
        if layer == "TXTz":
            from leafquarry.codec import bzz

            body = bzz.encode(body)
        forms.append(("page", f"p{n:04d}.djvu", iff.form("DJVU", [iff.chunk("INFO", payloads.info(LINE_WORDS * PITCH, PAGE_LINES * LEADING + n % 1000)), iff.chunk("INCL", b"shared.iff"), iff.chunk(layer, body)])))
    if n_thumbnails:
        forms.append(("thumbnail", "thumb.iff", iff.form("THUM", [iff.chunk("TH44", bytes([0, 1, 1, 2, 0, 8, 0, 8])) for _ in range(n_thumbnails)])))
    nav = [iff.chunk("NAVM", payloads.navm(outline))] if outline else []
    entries = [{"offset": 0, "size": len(f), "kind": kind, "id": name} for kind, name, f in forms]
    at = 4 + 12 + len(iff.chunk("DIRM", payloads.dirm(entries))) + sum(map(len, nav))
    for e in entries:
        e["offset"] = at
        at += e["size"]
    return iff.container(iff.form("DJVM", [iff.chunk("DIRM", payloads.dirm(entries)), *nav, *[f for _, _, f in forms]]))
