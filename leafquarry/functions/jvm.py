"""Column functions that run in the executors' JVM: `jvm/Codecs.java`, compiled once a session by the Janino that Spark brings along.

The driver compiles the source, packs the classes into a jar and hands that to Spark, which serves it to executors by itself: no compiler,
file or package is needed on them.
"""

from __future__ import annotations

import io
import zipfile
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession

_SOURCE = "Codecs.java"
#: Class loaders by Spark application: a jar is made once for each.
_loaders: dict[str, object] = {}


def _loader(spark: SparkSession):
    sc = spark.sparkContext
    if sc.applicationId not in _loaders:
        from leafquarry.codec import zp

        jvm = spark._jvm
        source = resources.files("leafquarry.jvm").joinpath(_SOURCE).read_text().replace("@TABLES@", zp._RAW.hex())
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook(source)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        jar = jvm.java.io.File.createTempFile("leafquarry-codecs", ".jar")
        jar.deleteOnExit()
        jvm.java.nio.file.Files.write(jar.toPath(), packed.getvalue(), sc._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        sc._jsc.addJar(jar.getAbsolutePath())
        urls = sc._gateway.new_array(jvm.java.net.URL, 1)
        urls[0] = jar.toURI().toURL()
        _loaders[sc.applicationId] = jvm.java.net.URLClassLoader(urls, jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    return _loaders[sc.applicationId]


def call(df: DataFrame, name: str, returns: str, *columns: Column) -> Column:
    """The function `name` of Codecs.java over columns, for df's session."""
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    spark = df.sparkSession
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            out[k] = item
        return out

    of = lambda name: jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader().loadClass(name)
    made = _loader(spark).loadClass(f"leafquarry.Codecs${name}").getDeclaredConstructor(array(jvm.java.lang.Class)).newInstance(array(jvm.java.lang.Object))
    types = array(jvm.java.lang.Class, of(f"org.apache.spark.sql.api.java.UDF{len(columns)}"), of("org.apache.spark.sql.types.DataType"))
    make = of("org.apache.spark.sql.functions").getMethod("udf", types)  # by its exact types: other functions of this name take any object
    # called not deterministic, so that the optimizer never puts a second copy of a call into a filter or a projection
    udf = make.invoke(None, array(jvm.java.lang.Object, made, jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))).asNondeterministic()
    return Column(udf.apply(_to_seq(spark.sparkContext, list(columns), _to_java_column)))
