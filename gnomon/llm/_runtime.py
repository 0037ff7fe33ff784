"""Session plumbing shared by the corpus operators: scratch tables, sieves, joins that stand hot keys, batch sizes.

No plan depends on a table's size. Wide rows (texts, signatures) are kept from shuffles by sieves: bit filters of a fixed
size over the keys that matter, tested in the scan. A sieve lets every wanted row through and few others; the exact join
or grouping follows, on the rows it let through. With far more keys than it was made for a sieve lets everything through,
and what is left is the plain shuffled join."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of a sieve, a power of two from 1024 on (1 MB; the session may set spark.gnomon.sieve.words), and words of
#: its rows. A key sets three bits of a word: with a million keys a sieve lets through about 1 row in 20 that isn't wanted.
SIEVE_WORDS, _ROW = 1 << 17, 1 << 10
#: Parts over which the rows of one key are dealt in joins and groupings.
SALTS = 256
#: Rows and bytes of an Arrow batch handed to Python workers; bounds their memory on long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Scratch tables after which the driver gives memory back.
SETTLE = 2
#: Per cent of its heap that the driver's JVM leaves free, at least and at most, when it gives memory back.
FREE = (10, 20)

_roots: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[str, int] = {}
_compiled: dict[tuple[str, str], object] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset (tests, local mode)."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="gnomon-")
        _roots[app] = f"{base.rstrip('/')}/gnomon-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _roots[app]


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Frames that read them must have been consumed."""
    try:
        root = _roots.pop(spark.sparkContext.applicationId, None)
        if root:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone by the time the interpreter ends
        pass


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    _written[app] = _written.get(app, 0) + 1
    if _written[app] % SETTLE == 0:
        settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def sieve(spark: SparkSession, keys: DataFrame, *columns: str) -> Callable[..., Column]:
    """A test of columns like `columns` of `keys`: true for every row whose values are among the keys', and for few others.
    The test names its columns several times; `bound` keeps dear ones from being computed as often.

    A key's hash gives a word and three bits of it. The words are gathered by DataFrame functions and reach the tasks as the
    value of a one-row subquery."""
    size = int(spark.conf.get("spark.gnomon.sieve.words", str(SIEVE_WORDS)))

    def place(h: Column) -> tuple[Column, Column]:
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 6, 12)]
        return F.shiftrightunsigned(h, 64 - (size.bit_length() - 1)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    word, bits = place(F.col("h"))
    parts = keys.select(F.xxhash64(*columns).alias("h")).select(word.alias("w"), bits.alias("b"))
    parts = parts.unionByName(spark.range(size).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))).groupBy("w").agg(F.bit_or("b").alias("b"))
    # Two steps, so that no task puts more than a few thousand words in order.
    rows = parts.groupBy(F.expr(f"w div {_ROW}").alias("r")).agg(F.expr("transform(array_sort(collect_list(struct(w, b))), x -> x.b)").alias("bs"))
    whole = table(spark, rows.agg(F.expr("transform(array_sort(collect_list(struct(r, bs))), x -> x.bs)").alias("words")), "sieve")

    def test(*values) -> Column:
        word, bits = place(F.xxhash64(*values))
        row, col = F.shiftright(word, _ROW.bit_length() - 1).cast("int"), word.bitwiseAND(F.lit(_ROW - 1)).cast("int")
        return whole.scalar()[row][col].bitwiseAND(bits) == bits

    return test


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column `name`, computed once: a generator of one row, into which no later use is folded."""
    return df.withColumn(name, F.explode(F.array(value)))


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def attach(rows: DataFrame, found: DataFrame, on: list[str], by: list[str], keys: DataFrame | None = None) -> DataFrame:
    """rows left-joined to `found`, which has one row for each key, where a key may hold most of rows: its rows are dealt
    over SALTS parts by the columns `by`, and only the parts that there are get a copy of the key's row of `found`.

    keys: on and by of all rows, where a table has them; spares a second computation of rows."""
    parts = (rows if keys is None else keys).select(*on, salt(*by).alias("__salt")).distinct()
    return rows.withColumn("__salt", salt(*by)).join(parts.join(found, on), [*on, "__salt"], "left").drop("__salt")


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches, make this package importable on the workers, and give back what earlier work left on
    the driver and the executors."""
    settle(spark)
    settle_executors(spark)
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or int(now) > value or int(now) <= 0:
            try:
                spark.conf.set(key, value)
            except Exception:  # a setting this Spark version doesn't know
                pass
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        path = Path(tempfile.mkdtemp(prefix="gnomon-code-")) / "gnomon_code.zip"
        path.write_bytes(held.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def trim() -> None:
    """Give memory that this process has freed back to the system. Arrow and the C library keep it apart from each other."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        given = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if given is not None:
            given(0)


def trimmed(run):
    """run, a function of Arrow batches, giving freed memory back when a task ends: workers stay alive between stages, and
    what one stage needed must not add up with what the next one needs."""

    def held(batches):
        yield from run(batches)
        trim()

    return held


def _tight(jvm, run: Callable[[], None]) -> None:
    """run while the JVM is bound to leave little of its heap free; after it the bounds are what they were."""
    try:
        of = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        names = ("MinHeapFreeRatio", "MaxHeapFreeRatio")
        was = [of.getVMOption(n).getValue() for n in names]
        now = [str(min(int(a), b)) for a, b in zip(was, FREE, strict=True)]
    except Exception:  # a JVM without these
        return run()
    try:
        for n, v in zip(names, now, strict=True):  # the lower first: at no time may the least be over the most
            of.setVMOption(n, v)
        run()
    except Exception:  # bounds that can't be set while the JVM runs
        run()
    finally:
        for n, v in zip(reversed(names), reversed(was), strict=True):
            try:
                of.setVMOption(n, v)
            except Exception:
                pass


def _trim_jvm(spark: SparkSession) -> None:
    """Let the C library of the driver's JVM give back what it has freed; JVMs that can't are left as they are."""
    try:
        jvm = spark._jvm
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, args)
    except Exception:
        pass


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM drop plans and blocks of work past and give the memory back, heap and C library's, and this
    process its freed memory. A heap that a burst of tasks has widened stays wide by itself."""
    gc.collect()
    _tight(spark._jvm, spark._jvm.System.gc)
    _trim_jvm(spark)
    trim()


def settle_executors(spark: SparkSession) -> None:
    """Let the executors' JVMs drop what earlier stages left and give heap back: a task for each core calls their collector.
    A stage's Python workers then have the memory that heaps widened by the stages before would hold."""
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return  # tasks run in the driver's JVM, which `settle` sees to
    n = max(1, spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    except Exception:  # sessions that don't allow calls of Java methods
        pass


def java_functions(spark: SparkSession, source: Path, functions: dict[str, tuple[str, str]]) -> None:
    """Register classes of a Java source file as functions: for each name the class and the type it returns. The driver compiles
    the file by Janino, as Spark does its plans; the executors get the classes in a jar."""
    jvm, app = spark._jvm, (spark.sparkContext.applicationId, str(source))
    if app not in _compiled:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jsparkSession.getClass().getClassLoader())
        compiler.cook(source.read_text())
        path = Path(tempfile.mkdtemp(prefix="gnomon-code-")) / f"{source.stem}.jar"
        with zipfile.ZipFile(path, "w") as z:
            for entry in compiler.getBytecodes().entrySet():
                z.writestr(entry.getKey().replace(".", "/") + ".class", entry.getValue())
        spark.sparkContext._jsc.addJar(str(path))
        _compiled[app] = compiler.getClassLoader()
    for name, (cls, kind) in functions.items():
        spark._jsparkSession.udf().register(name, _compiled[app].loadClass(cls).newInstance(), jvm.org.apache.spark.sql.types.DataType.fromDDL(kind))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns called in0, in1 and so on, which no inner name is, and these names."""
    names = [f"in{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns in0, in1 and so on of df under their names in docs."""
    return df.select(*[F.col(f"in{k}").alias(c) for k, c in enumerate(docs.columns)])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_hash(column: str = "doc_id"):
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
