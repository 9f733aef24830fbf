"""The byte-serial coders as SQL functions of the JVM.

The Java sources beside this file are compiled when a session first needs them, by the compiler that Spark
ships for its own generated code; nothing is built beforehand. The classes go to all executors as a session
jar. A coder has one block at a time, so that a row is what a task does again if an executor is lost.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

_HERE = os.path.dirname(os.path.abspath(__file__))
_BYTES, _FOUND = "binary", "struct<bytes:binary,error:string>"
#: Result types by class.
_TYPES = {
    "Sort": "struct<data:binary,primary_index:long>",
    "Order": "array<int>",
    "Unsort": _BYTES,
    "Ranks": _BYTES,
    "Unrank": _BYTES,
    "Runs": "array<long>",
    "RunEncode": "struct<symbols:long,payload:binary>",
    "RunDecode": _BYTES,
    "MixEncode": _BYTES,
    "MixDecode": _BYTES,
    "Collapse": _BYTES,
    "Expand": _FOUND,
    "Restore": _FOUND,
    "Checksum": "long",
    "Join": _BYTES,
    "Read": _BYTES,
}
#: The functions' objects by application; sessions of one application share them.
_OBJECTS: dict[str, tuple] = {}
#: No limit to a payload's size.
NO_LIMIT = (1 << 63) - 1


def _sql_name(kind: str) -> str:
    return "blockloom_" + kind.lower()


def _compiled(spark: SparkSession) -> tuple:
    """The maker of functions, and their objects by class."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    folder = tempfile.mkdtemp(prefix="blockloom-kernels-")
    classes = {}
    loader = None
    for source in ("Kernels", "Functions"):
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        if loader is not None:
            compiler.setParentClassLoader(loader)
        with open(os.path.join(_HERE, f"{source}.java"), encoding="utf-8") as file:
            compiler.cook(file.read())
        found = compiler.getBytecodes()
        classes |= {name: bytes(found[name]) for name in found}
        loader = compiler.getClassLoader()
    jar = os.path.join(folder, "kernels.jar")
    with zipfile.ZipFile(jar, "w") as out:
        for name, code in classes.items():
            out.writestr(name.replace(".", "/") + ".class", code)
    spark.sql(f"ADD JAR '{jar}'")
    known = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    none = gateway.new_array(jvm.java.lang.Object, 0)
    made = lambda kind: known.loadClass(f"blockloom.Functions${kind}").getDeclaredConstructors()[0].newInstance(none)
    return made("Maker"), {kind: made(kind) for kind in _TYPES}


def install(spark: SparkSession) -> None:
    """Makes the functions known to a session; later calls cost nothing."""
    if spark.catalog.functionExists(_sql_name("Join")):
        return
    app = spark.sparkContext.applicationId
    if app not in _OBJECTS:
        _OBJECTS[app] = _compiled(spark)
    maker, objects = _OBJECTS[app]
    for kind, made in objects.items():
        result = spark._jsparkSession.parseDataType(_parse_datatype_string(_TYPES[kind]).json())
        spark._jsparkSession.udf().register(_sql_name(kind), maker.make(made, result))


def ready(df: DataFrame) -> DataFrame:
    """The same rows, in a session that knows the functions."""
    install(df.sparkSession)
    return df


def _call(kind: str, *args: Column | str | int) -> Column:
    return F.call_function(_sql_name(kind), *(F.lit(a) if isinstance(a, int) else F.col(a) if isinstance(a, str) else a for a in args))


def sort(block: Column | str) -> Column:
    """(data, primary_index): a block's last column without the sentinel, and the sentinel's row."""
    return _call("Sort", block)


def order(block: Column | str) -> Column:
    """Where a block's suffixes start, in their order."""
    return _call("Order", block)


def unsort(data: Column | str, primary: Column | str) -> Column:
    return _call("Unsort", data, primary)


def ranks(data: Column | str) -> Column:
    """Recency ranks of the bytes."""
    return _call("Ranks", data)


def unrank(data: Column | str) -> Column:
    return _call("Unrank", data)


def runs(block: Column | str, edges: bool) -> Column:
    """Runs of equal bytes, those that touch an edge of the block or the others: start << 32 | length << 8 | byte."""
    return _call("Runs", block, edges)


def run_encode(data: Column | str, extension: int, limit: Column | int = NO_LIMIT) -> Column:
    """(symbols, payload) of recency ranks; null if the payload would not be under the limit."""
    return _call("RunEncode", data, extension, limit)


def run_decode(payload: Column | str, symbols: Column | str, size: Column | str) -> Column:
    return _call("RunDecode", payload, symbols, size)


def mix_encode(data: Column | str, limit: Column | int = NO_LIMIT) -> Column:
    """The mixing-coded payload; null if it would not be under the limit."""
    return _call("MixEncode", data, limit)


def mix_decode(payload: Column | str, size: Column | str) -> Column:
    return _call("MixDecode", payload, size)


def collapse(data: Column | str, bits: Column | int) -> Column:
    """The data with long repeats collapsed; null where that gains nothing."""
    return _call("Collapse", data, bits)


def expand(coded: Column | str, size: Column | str, bits: Column | int) -> Column:
    """(bytes, error) that collapsed data stands for."""
    return _call("Expand", coded, size, bits)


def restore(mode: Column, lzp: Column, size: Column, primary: Column, middle: Column, checksum: Column, payload: Column, bits: Column) -> Column:
    """(bytes, error) of a block whose header is sound."""
    return _call("Restore", mode, lzp, size, primary, middle, checksum, payload, bits)


def checksum(data: Column | str) -> Column:
    """Adler-32 as a long."""
    return _call("Checksum", data)


def join(parts: Column) -> Column:
    """An array of binaries as one."""
    return _call("Join", parts)


def read(path: Column | str, place: Column | str, length: Column | str) -> Column:
    """Bytes of a file from a place on; the file may be in any store that Spark reads."""
    return _call("Read", path, place, length)
