"""Sinks (K1-K3). Parquet is the default. Text exports keep line order by range-partitioning on the line
key and sorting inside each part; the parts, in name order, then become one plain file: joined by the file
system itself where it can (``concat``, no byte moves), copied one after the other through a fixed buffer
otherwise. Parts to be copied are written compressed and deleted as soon as they are copied, so that a text is not on
disk twice. The file gets its name by a rename at the end, so that an export that is cut off leaves none."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transpark.session import TEXT_CODEC, delete, freed_shuffles, materialize

COPY_BUFFER = 4 << 20
JOINS = 4  # files that the driver copies together at a time

CONCAT = "fs.capability.paths.concat"

SEGMENT_FILES = {"hyp": "hypothesis.hyp", "ref": "reference.ref", "src": "source.src"}


def one_line(c) -> Column:
    """A text cell as one line of a text file: null as empty, line ends as blanks."""
    return F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\r\n|\r|\n", " ")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _parts_options(spark: SparkSession, path: str) -> dict[str, str]:
    """How parts that become a file under ``path`` are written: plain where the file system joins them itself."""
    p, fs = _path(spark, path)
    return {} if fs.hasPathCapability(p, CONCAT) else {"compression": "lz4"}


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """One plain file ``target`` of the ``part-*`` files of ``folder`` in name order, replacing what is there. The
    parts are used up; compressed ones are unpacked."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = [_path(spark, f"{folder}/{n}")[0] for n in _children(spark, folder) if n.startswith("part-")]
    goal, fs = _path(spark, target)
    fs.mkdirs(goal.getParent())
    made = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{goal.getName()}.{uuid.uuid4().hex}")
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    packed = any(codecs.getCodec(p) is not None for p in parts)
    if len(parts) > 1 and not packed and fs.hasPathCapability(goal, CONCAT):
        fs.rename(parts[0], made)
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
        for i, p in enumerate(parts[1:]):
            rest[i] = p
        fs.concat(made, rest)
    else:
        out = fs.create(made, True)
        for p in parts:
            part, codec = fs.open(p), codecs.getCodec(p)
            part = codec.createInputStream(part) if codec is not None else part
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, COPY_BUFFER, False)
            part.close()
            fs.delete(p, False)
        out.close()
    if fs.exists(goal):
        fs.delete(goal, True)
    if not fs.rename(made, goal):
        raise OSError(f"{made} could not be renamed to {goal}")


def _join_all(spark: SparkSession, targets: dict[str, str]) -> None:
    """``join_parts`` of every folder to its target, ``JOINS`` at a time."""
    with ThreadPoolExecutor(JOINS) as pool:
        list(pool.map(lambda x: join_parts(spark, *x), targets.items()))


def write_segments(df: DataFrame, path: str, text_export: bool | str = False, mode: str = "overwrite") -> None:
    """K1: ``run, idx, src, ref, hyp`` -> Parquet partitioned by run (``path/parquet``). With ``text_export``
    also the aligned text files ``path/<run>/{source.src,reference.ref,hypothesis.hyp}``, from one pass over
    what was written, so that the input is evaluated once; ``"parts"`` leaves them as folders of part
    files, ``path/text/kind=<kind file>/run=<run>/part-*``, which tasks read in parallel."""
    columns = ["run", "idx", "src", "ref", "hyp"]
    with freed_shuffles(df.sparkSession):
        df.select(*columns).write.mode(mode).option("compression", TEXT_CODEC).partitionBy("run").parquet(f"{path}/parquet")
    if not text_export:
        return
    spark = df.sparkSession
    stored = spark.read.schema(df.select("idx", "src", "ref", "hyp", "run").schema).parquet(f"{path}/parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), one_line(c).alias("value")) for c, name in SEGMENT_FILES.items()])
    ordered = stored.repartitionByRange(n, "run", "idx").select("run", "idx", F.inline(kinds))
    ordered = ordered.sortWithinPartitions("kind", "run", "idx").select("kind", "run", "value")
    out = f"{path}/text" if text_export == "parts" else f"{path}/_text-{uuid.uuid4().hex}"
    packed = {} if text_export == "parts" else _parts_options(spark, path)
    with freed_shuffles(spark):
        ordered.write.mode(mode).options(**packed).partitionBy("kind", "run").text(out)
    if text_export == "parts":
        return
    targets = {}
    for kind in SEGMENT_FILES.values():
        for folder in _children(spark, f"{out}/kind={kind}"):
            run = unquote(folder.removeprefix("run="))
            if run == "parquet":
                raise ValueError("a run named 'parquet' has no folder of its own")
            targets[f"{out}/kind={kind}/{folder}"] = f"{path}/{run}/{kind}"
    _join_all(spark, targets)
    delete(spark, out)


def append_run_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K2: append metric rows; with ``fmt='csv'`` each part carries its header."""
    w = df.write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: ``dataset, split, idx, src, tgt`` (plus extras) partitioned by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_text_column(df: DataFrame, col: str, path: str, order_by: list[str], mode: str = "overwrite", one_file: bool = False) -> None:
    """One line per row in ``order_by`` order: a folder of part files, or with ``one_file`` the plain file ``path``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = f"{path}.parts-{uuid.uuid4().hex}" if one_file else path
    ordered = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    with freed_shuffles(spark):
        ordered.select(one_line(col).alias("value")).write.mode(mode).options(**(_parts_options(spark, path) if one_file else {})).text(out)
    if one_file:
        join_parts(spark, out, path)
        delete(spark, out)


def export_dataset(df: DataFrame, path: str, src_lang: str, tgt_lang: str, base: DataFrame | None = None) -> None:
    """K3 text form: ``split, idx, src, tgt`` -> the plain files ``path/{split}.{lang}``, line-aligned in ``idx``
    order, from one range-partitioned pass. With ``base`` the non-training splits of that dataset are copied
    along."""
    spark = df.sparkSession
    rows = df.select("split", "idx", "src", "tgt")
    if base is not None:
        rows = rows.filter(F.col("split") == "train").unionByName(base.filter(F.col("split") != "train").select(*rows.columns))
    rows = materialize(rows, "export")  # range bounds are sampled from it
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = F.array(*[F.struct(F.lit(lang).alias("lang"), one_line(c).alias("value")) for c, lang in (("src", src_lang), ("tgt", tgt_lang))])
    ordered = rows.repartitionByRange(n, "split", "idx").select("split", "idx", F.inline(sides))
    out = f"{path.rstrip('/')}/_text-{uuid.uuid4().hex}"
    ordered = ordered.sortWithinPartitions("split", "lang", "idx").select("split", "lang", "value")
    with freed_shuffles(spark):
        ordered.write.options(**_parts_options(spark, path)).partitionBy("split", "lang").text(out)
    targets = {}
    for split in _children(spark, out):
        if split.startswith("split="):
            for lang in _children(spark, f"{out}/{split}"):
                name = f"{unquote(split.removeprefix('split='))}.{unquote(lang.removeprefix('lang='))}"
                targets[f"{out}/{split}/{lang}"] = f"{path.rstrip('/')}/{name}"
    _join_all(spark, targets)
    delete(spark, out)
