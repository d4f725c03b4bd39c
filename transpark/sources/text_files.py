"""Line-aligned text corpora as DataFrames with exact line numbers.

A line's identity is its number in its file. Spark's text source gives no
line number, so lines are numbered per file split: one scan writes every line
with its split and position under the checkpoint folder, and the offset of
each split comes from the counts of that written table (one row per split).
Offsets and lines so always stem from the same split layout, whatever the
settings are when the result is used. No global sort and no window over lines.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transpark.operators.common import join_small
from transpark.session import TEXT_CODEC, materialize

PART_FILE = r"/part-[0-9]+[^/]*$"


# What ``str.splitlines`` takes for line ends beside those of text files.
EXTRA_SEPARATOR = r"[\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def read_lines(spark: SparkSession, path, strict_splitlines: bool = False, parts_as_one: bool = True) -> DataFrame:
    """``file STRING, idx LONG, text STRING`` with ``idx`` = 0-based line number in the file.

    With ``parts_as_one`` the ``part-*`` files of a Spark output folder form one
    logical file (the folder), numbered on across the parts in name order.
    ``strict_splitlines`` gives the lines of Python's ``str.splitlines``, which also cuts at
    VT, FF, FS, GS, RS, NEL, LS and PS: lines are cut before they are numbered, so that no text is sorted.
    """
    paths = path if isinstance(path, (list, tuple)) else [path]
    meta = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.text(list(paths))
    if strict_splitlines:
        raw = raw.select(F.explode(F.split("value", EXTRA_SEPARATOR, -1)).alias("text"), *meta)
    else:
        raw = raw.select(F.col("value").alias("text"), *meta)
    # numbers grow along a scan task, also across the pieces of a line
    raw = raw.select("*", F.monotonically_increasing_id().alias("_mid"))
    unit = F.regexp_replace("_path", PART_FILE, "") if parts_as_one else F.col("_path")
    raw = materialize(raw.withColumn("file", unit), "lines", TEXT_CODEC)
    blocks = raw.groupBy("file", "_path", "block").agg(F.min("_mid").alias("_m0"), F.count("*").alias("_n"))
    if strict_splitlines:
        raw, blocks = _without_open_ends(spark, raw, blocks)
    w = Window.partitionBy("file").orderBy("_path", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("file", "_path", "block", "_m0", "_off")
    return join_small(raw, blocks, ["file", "_path", "block"]).select(
        "file", (F.col("_off") + F.col("_mid") - F.col("_m0")).alias("idx"), "text"
    )


def _without_open_ends(spark: SparkSession, raw: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and block counts without the empty piece after a separator that ends its file: it is a line
    only if a newline follows. One row for each such file is looked at; files without one cost nothing."""
    last = raw.groupBy("_path").agg(F.max_by(F.struct("block", "_mid", "text"), F.struct("block", "_mid")).alias("last"))
    open_ = [r for r in last.where("last.text = ''").select("_path", "last.block", "last._mid").collect() if not _ends_line(spark, r["_path"])]
    if not open_:
        return raw, blocks
    gone = spark.createDataFrame([(r["_path"], r["block"], r["_mid"]) for r in open_], "_path string, block long, _mid long")
    raw = join_small(raw, gone, ["_path", "block", "_mid"], "left_anti")
    less = gone.select("_path", "block", F.lit(1).alias("_less"))
    blocks = blocks.join(F.broadcast(less), ["_path", "block"], "left").withColumn("_n", F.col("_n") - F.coalesce("_less", F.lit(0)))
    return raw, blocks.where("_n > 0").drop("_less")


def _ends_line(spark: SparkSession, path: str) -> bool:
    """Whether the last byte of a (plain) file is a line end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(p)
    try:
        stream.seek(fs.getFileStatus(p).getLen() - 1)
        return stream.read() in (10, 13)
    finally:
        stream.close()


def _suffix_path(stem: str, lang: str) -> str:
    return f"{stem}.{lang}"


def read_parallel(spark: SparkSession, stem: str, src: str, tgt: str, strict: bool = True) -> DataFrame:
    """S2 + J1: ``idx, src, tgt`` from ``stem.src`` and ``stem.tgt``, aligned by line number.

    ``strict=True`` raises when the files differ in length; ``strict=False``
    keeps the pairs both files have (zip).
    """
    lines = read_lines(spark, [_suffix_path(stem, src), _suffix_path(stem, tgt)])
    lines = lines.withColumn("lang", F.regexp_extract("file", r"\.([^./]+)$", 1))
    return _paired(lines, src, tgt, [], strict)


def _paired(lines: DataFrame, src: str, tgt: str, by: list[str], strict: bool) -> DataFrame:
    """``by..., idx, src, tgt`` of stored ``by..., lang, idx, text``. Line numbers are dense, so lengths are
    compared by counts (one row per file), and the text moves once, to its partner, without another copy."""
    if strict:
        n = lambda lang: F.count(F.when(F.col("lang") == lang, 1))
        sizes = lines.groupBy(*by).agg(n(src).alias("left"), n(tgt).alias("right"))
        if bad := sizes.where("left <> right").limit(5).collect():
            raise ValueError(f"aligned files differ in length: {[tuple(r) for r in bad]}")
    a = lines.filter(F.col("lang") == src).select(*by, "idx", F.col("text").alias("src"))
    b = lines.filter(F.col("lang") == tgt).select(*by, "idx", F.col("text").alias("tgt"))
    return a.join(b, [*by, "idx"], "inner")


def align(left: DataFrame, right: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """Positional zip of two line sets on their line keys (null-safe text: a null cell is a cell).

    ``strict`` raises if a line has no partner: the keys of both sides are counted against each other first,
    so inputs should be stored ones; texts are joined once and not written again."""
    if strict:
        keys = left.select(*on, F.lit(1).alias("_tp_l"), F.lit(0).alias("_tp_r")).unionByName(right.select(*on, F.lit(0).alias("_tp_l"), F.lit(1).alias("_tp_r")))
        sides = keys.groupBy(*on).agg(F.max("_tp_l").alias("_tp_l"), F.max("_tp_r").alias("_tp_r"))
        alone = sides.agg(F.count(F.when(F.col("_tp_r") == 0, 1)), F.count(F.when(F.col("_tp_l") == 0, 1))).first()
        if alone[0] or alone[1]:
            raise ValueError(f"aligned inputs differ in length: {alone[0]} lines only left, {alone[1]} only right")
    return left.join(right, on, "inner")


SPLIT_FILES = {"train": "train", "dev": "dev", "val": "dev", "valid": "dev", "test": "test"}


def read_dataset(
    spark: SparkSession,
    directory: str,
    src: str,
    tgt: str,
    splits=("train", "dev", "test"),
    dataset: str | None = None,
    strict: bool = True,
) -> DataFrame:
    """S3: ``dataset, split, idx, src, tgt`` for ``{split}.{lang}`` files of one folder, read in one scan.

    ``strict=True`` raises when the two languages of a split differ in length."""
    stems = sorted({SPLIT_FILES.get(s, s) for s in splits})
    paths = [p for s in stems for lang in (src, tgt) for p in [f"{directory.rstrip('/')}/{s}.{lang}"] if _exists(spark, p)]
    if not paths:
        raise FileNotFoundError(f"no {src}/{tgt} split files under {directory}")
    lines = read_lines(spark, paths).withColumn("_base", F.regexp_extract("file", r"([^/]+)$", 1))
    lines = lines.withColumn("split", F.regexp_extract("_base", r"^([^.]+)\.", 1)).withColumn(
        "lang", F.regexp_extract("_base", r"\.([^.]+)$", 1)
    )
    out = _paired(lines, src, tgt, ["split"], strict)
    return out.select(F.lit(dataset or os.path.basename(directory.rstrip("/"))).alias("dataset"), "split", "idx", "src", "tgt")


def _exists(spark: SparkSession, path: str) -> bool:
    """Existence through the cluster's Hadoop file system (any scheme)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


KINDS = {"hypothesis.hyp": "hyp", "reference.ref": "ref", "source.src": "src"}


def read_segments(
    spark: SparkSession, root: str, runs: list[str] | None = None, layout: str = "runs", strict: bool = True
) -> DataFrame:
    """``run, idx, src, ref, hyp`` for every run under ``root`` in one scan and one shuffle.

    ``layout="runs"``: ``root/<run>/{hypothesis.hyp,reference.ref,source.src}`` files;
    ``layout="parts"``: what ``write_segments(..., text_export="parts")`` writes,
    ``root/text/kind=<kind file>/run=<run>/part-*``. ``strict=True`` raises when the files of
    a run differ in length; ``strict=False`` leaves the missing cells null."""
    names = runs or ["*"]
    base = root.rstrip("/")
    if layout == "parts":
        paths = [f"{base}/text/kind={k}/run={r}" for r in names for k in KINDS]
    else:
        paths = [f"{base}/{r}/{k}" for r in names for k in KINDS]
    lines = read_lines(spark, paths)
    parts = F.split(F.col("file"), "/")
    kinds = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    run, kind = (F.element_at(parts, -1), F.element_at(parts, -2)) if layout == "parts" else (F.element_at(parts, -2), F.element_at(parts, -1))
    lines = lines.withColumn("run", F.regexp_replace(run, "^run=", "")).withColumn(
        "kind", F.element_at(kinds, F.regexp_replace(kind, "^kind=", ""))
    )
    if strict:
        # line numbers are dense, so lengths are compared by counts (one row per file)
        sizes = lines.groupBy("run", "kind").agg(F.count("*").alias("n")).groupBy("run")
        uneven = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))
        bad = uneven.filter((F.col("lo") != F.col("hi")) | (F.col("k") < len(KINDS))).limit(5).collect()
        if bad:
            raise ValueError(f"the files of a run differ in length or are missing: {[r['run'] for r in bad]}")
    return (
        lines.groupBy("run", "idx")
        .pivot("kind", ["src", "ref", "hyp"])
        .agg(F.max("text"))
        .select("run", "idx", "src", "ref", "hyp")
    )


def read_vocab(spark: SparkSession, path: str, specials=("<s>", "<pad>", "</s>", "<unk>")) -> DataFrame:
    """``token, cnt, id`` from a ``token count`` file; ids follow the file order after the special symbols."""
    lines = read_lines(spark, path)
    body = lines.select(
        F.regexp_extract("text", r"^(.*) ([0-9]+)$", 1).alias("token"),
        F.regexp_extract("text", r"^(.*) ([0-9]+)$", 2).cast("long").alias("cnt"),
        (F.col("idx") + F.lit(len(specials))).cast("int").alias("id"),
    )
    spec = spark.createDataFrame([(s, 1, i) for i, s in enumerate(specials)], "token STRING, cnt LONG, id INT")
    return spec.unionByName(body)
