"""Safety of serialized models and of the packages they were built with.

Artifacts are rows with their bytes, or files of a folder that the tasks read as streams, so a checkpoint larger than an executor's
memory is scanned too.  Python decodes opcodes alone; what an import means, findings and refusals are expressions and aggregates.

Defined results: null or empty bytes have status empty and count as unreadable; a stream cut short is truncated and keeps the imports
before the cut; repeated artifacts each give their findings; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import opcodes
from ..functions.patterns import SEVERITIES, severity_rank

# Fixed values.
PICKLE_SUFFIXES = ["pkl", "pickle", "joblib", "pt", "pth", "ckpt", "bin", "npy"]
SAFE_SUFFIXES = ["safetensors", "onnx", "json", "txt", "ubj"]
WEIGHT_SUFFIXES = ["safetensors", "onnx", "gguf"]
#: modules any import of which can run code, reach files or the network
DANGEROUS_MODULES = [
    "os", "nt", "posix", "sys", "subprocess", "_posixsubprocess", "pty", "shutil", "runpy", "code", "codeop", "importlib", "imp", "pkgutil", "zipimport", "ctypes", "cffi", "socket", "ssl", "asyncio", "multiprocessing",
    "http", "httplib", "urllib", "urllib2", "requests", "aiohttp", "ftplib", "smtplib", "telnetlib", "xmlrpc", "webbrowser", "pickle", "_pickle", "cPickle", "marshal", "shelve", "dill", "cloudpickle",
    "bdb", "pdb", "timeit", "trace", "cProfile", "profile", "doctest", "pip", "ensurepip", "venv", "tempfile", "glob", "pathlib", "signal", "threading", "inspect", "gc", "types", "commands",
]
DANGEROUS_NAMES = [
    *[f"{module}.{name}" for module in ("builtins", "__builtin__") for name in ("eval", "exec", "execfile", "compile", "open", "file", "input", "breakpoint", "getattr", "setattr", "delattr", "globals", "locals", "vars", "apply", "__import__")],
    "operator.attrgetter", "operator.itemgetter", "operator.methodcaller", "functools.partial", "functools.reduce", "torch.load", "torch.hub.load", "numpy.load", "joblib.load", "pandas.read_pickle", "numpy.testing._private.utils.runstring",
]
#: imports that plain data needs
SAFE_NAMES = [
    *[f"{module}.{name}" for module in ("builtins", "__builtin__") for name in ("set", "frozenset", "list", "dict", "tuple", "int", "float", "complex", "bool", "str", "bytes", "bytearray", "object", "slice", "range", "unicode", "long")],
    "collections.OrderedDict", "collections.defaultdict", "collections.Counter", "collections.deque", "copyreg._reconstructor", "copy_reg._reconstructor", "_codecs.encode", "datetime.datetime", "datetime.date", "datetime.timedelta", "decimal.Decimal",
    *[f"{module}.{name}" for module in ("numpy.core.multiarray", "numpy._core.multiarray") for name in ("_reconstruct", "scalar")], "numpy.ndarray", "numpy.dtype",
    *[f"torch._utils.{name}" for name in ("_rebuild_tensor", "_rebuild_tensor_v2", "_rebuild_parameter")], "torch.FloatStorage", "torch.HalfStorage", "torch.BFloat16Storage", "torch.LongStorage", "torch.IntStorage",
]
IGNORED_STATUS = ["ok", "data"]

IMPORTS = "array<struct<module:string,name:string>>"
_ARROW = pa.list_(pa.struct([("module", pa.string()), ("name", pa.string())]))


def _columns(results: list[tuple[set[tuple[str, str]], str]]) -> list[pa.Array]:
    imports = [[{"module": m, "name": n} for m, n in sorted(found)] for found, _ in results]
    return [pa.array(imports, _ARROW), pa.array([status for _, status in results], pa.string())]


def scan_content(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, imports (distinct, sorted), status of each row's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [opcodes.scan_bytes(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(results)], [key, "imports", "status"])

    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{content}`").cast("binary").alias("__content"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, imports {IMPORTS}, status string")


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part, empty without one."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r".\.([^.]+)$", 1))


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, imports, status of the weights and pickles anywhere under a folder; configuration and vocabulary files are left out.

    Only names and sizes are listed; the tasks, dealt by size, stream the pickles and open no other file.  A file that cannot be read is malformed.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    listed = listed.where(suffix(F.col("path")).isin(PICKLE_SUFFIXES + WEIGHT_SUFFIXES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                result: tuple[set[tuple[str, str]], str] = (set(), "data")
                if path.rsplit(".", 1)[-1].lower() in PICKLE_SUFFIXES:
                    try:
                        store, inner = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:/") else fs.FileSystem.from_uri(quote(path, safe=":/@"))
                        with store.open_input_file(inner) as stream:
                            result = opcodes.scan(stream)
                    except OSError:
                        result = (set(), "malformed")
                yield pa.RecordBatch.from_arrays([pa.array([path]), *_columns([result])], ["path", "imports", "status"])

    return listed.mapInArrow(run, f"path string, imports {IMPORTS}, status string")


def safety(module: Column, name: Column) -> Column:
    """dangerous, safe or suspicious; what could not be resolved is dangerous."""
    full, root = F.concat(module, F.lit("."), name), F.substring_index(module, ".", 1)
    dangerous = root.isin(DANGEROUS_MODULES) | full.isin(DANGEROUS_NAMES) | (module == opcodes.UNRESOLVED) | (name == opcodes.UNRESOLVED)
    # a dotted name walks through attributes: os.path of another module, say
    walks = F.exists(F.split(name, r"\."), lambda part: part.isin(DANGEROUS_MODULES)) & F.contains(name, F.lit("."))
    return F.when(dangerous | walks, "dangerous").when(full.isin(SAFE_NAMES), "safe").otherwise("suspicious")


def judged(scanned: DataFrame) -> DataFrame:
    """scanned with dangerous (module.name, sorted), suspicious (top modules, sorted) and refused: what must not be loaded."""
    of = lambda kind: F.filter("imports", lambda g: safety(g["module"], g["name"]) == kind)
    dangerous = F.array_sort(F.transform(of("dangerous"), lambda g: F.concat(g["module"], F.lit("."), g["name"])))
    suspicious = F.array_sort(F.array_distinct(F.transform(of("suspicious"), lambda g: F.substring_index(g["module"], ".", 1))))
    out = scanned.withColumns({"dangerous": dangerous, "suspicious": suspicious})
    return out.withColumn("refused", (F.size("dangerous") > 0) | ~F.col("status").isin(IGNORED_STATUS))


def findings(scanned: DataFrame, path: str) -> DataFrame:
    """scanner, category, severity, location, count, details of scanned artifacts with a path column, one to three rows each."""
    rows, kind = judged(scanned), suffix(F.col(f"`{path}`"))
    none = F.array().cast("array<string>")
    row = lambda category, severity, count, details: F.struct(F.lit("artifact").alias("scanner"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.col(f"`{path}`").alias("location"), count.cast("long").alias("count"), details.alias("details"))
    code = F.array_compact(F.array(
        F.when(~F.col("status").isin(IGNORED_STATUS), row("SCAN_ERROR", "high", F.lit(1), F.array("status"))),
        F.when(F.size("dangerous") > 0, row("UNSAFE_PICKLE", "critical", F.size("dangerous"), F.col("dangerous"))),
        F.when(F.col("status").isin(IGNORED_STATUS), row("RAW_PICKLE_FORMAT", "low", F.size("imports"), F.col("suspicious"))),
    ))
    found = F.when(kind.isin(SAFE_SUFFIXES), F.array(row("SAFE_FORMAT", "info", F.lit(1), none))).when(kind.isin(PICKLE_SUFFIXES), code).otherwise(F.array(row("UNKNOWN_FORMAT", "low", F.lit(1), none)))
    return rows.select(F.inline(found))


def refuse_unsafe(scanned: DataFrame) -> DataFrame:
    """The artifacts that may be loaded: read to their end, without a dangerous import."""
    return judged(scanned).where("not refused").select(*scanned.columns)


def dependency_findings(dependencies: DataFrame, advisories: DataFrame, severities: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """scanner, category, severity, location, count, details of the dependencies (name, version) that advisories (name, version, id, aliases,
    fix_versions, position) speak of.

    An id counts once, for its first package by position, name and version; of advisories that still tie, one without a CVE name goes first, then the
    first CVE name, then the fix versions (nulls last in these).  Its severity is that of severities (id, severity) under its GHSA name, medium
    where none is known; of more than one the severest counts.  The category is the first CVE name, else the id.
    """
    pins = dependencies.select("name", "version").where(~F.lower("name").isin(*ignored) if ignored else F.lit(True)).distinct()
    hit = advisories.join(pins, ["name", "version"]).groupBy("id")
    cve = F.get(F.filter(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n.startswith("CVE-")), F.lit(0))
    last = lambda c: F.struct(c.isNull(), c)
    order = F.struct(last(F.col("position")), "name", "version", cve, F.transform("fix_versions", last), "aliases")
    one = hit.agg(F.min_by(F.struct("name", "version", "aliases", "fix_versions"), order).alias("v")).select("id", "v.*")
    names = F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))
    starts = lambda head: F.get(F.filter(names, lambda n: n.startswith(head)), F.lit(0))
    one = one.withColumns({"ghsa": starts("GHSA-"), "cve": starts("CVE-")})
    known = severities.groupBy(F.col("id").alias("ghsa")).agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    rank = F.when(F.col("rank") > 0, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank").cast("int")))
    out = one.join(known, "ghsa", "left")
    return out.select(
        F.lit("dependencies").alias("scanner"), F.coalesce("cve", "id").alias("category"), F.coalesce(rank, F.lit("medium")).alias("severity"), F.concat("name", F.lit("=="), "version").alias("location"), F.lit(1).cast("long").alias("count"),
        F.struct("id", "aliases", "fix_versions", F.when(rank.isNotNull(), "ghsa").otherwise("unknown").alias("severity_source")).alias("details"),
    )
