"""Readers of the metadata layouts: delimited tables, transcription lists, mappings, segment files, listings, stored graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexure.operators.etl import last_of_each, normalize_header, segments, spoken_text, tagged

#: The columns that a dataset must have, header aliases of id-keyed lists, and file endings by priority.
REQUIRED = ("audio_path", "transcription", "speaker_id")
ID_ALIASES = ("id", "index", "num", "number", "ste")
TEXT_ALIASES = ("ewondo", "text", "transcription", "phrase")
ENDINGS = ("mp3", "wav", "m4a", "flac")
ENCODINGS = ("UTF-8", "ISO-8859-1")

EXAMPLE = T.StructType([
    T.StructField("waveform", T.ArrayType(T.DoubleType())), T.StructField("sample_rate", T.IntegerType()), T.StructField("transcription", T.StringType()),
    T.StructField("speaker_id", T.StringType()), T.StructField("audio_path", T.StringType()), T.StructField("phonemes", T.ArrayType(T.StringType())),
    T.StructField("word_timestamps", T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def _file_order() -> Column:
    """Where a row stands in what it was read from: by file name, split of the file, and place in the split. How Spark packs files into tasks does not matter."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def delimiter(spark: SparkSession, path: str) -> str:
    """Of a file's first line: tab before semicolon before comma."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return next((d for d in ("\t", ";") if d in line), ",")


def delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multiline: bool = False) -> DataFrame:
    """All columns as strings, headers normalised. Without an encoding: UTF-8 if every line is valid, else Latin-1, which takes any bytes.

    Lines are tested and parsed in splits of the files. ``multiline``: quoted values may hold line ends; each file is then one task.
    """
    if encoding is None:
        lines = spark.read.option("encoding", ENCODINGS[1]).csv(path, sep="\x01", quote="", schema="line string")
        bad = lines.filter(~F.is_valid_utf8(F.encode("line", ENCODINGS[1]).cast("string"))).limit(1).count()
        encoding = ENCODINGS[bool(bad)]
    return normalize_header(spark.read.csv(path, header=True, sep=sep or delimiter(spark, path), encoding=encoding, multiLine=multiline, escape='"'))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A metadata table that has the required columns, else an error that names those missing."""
    df = delimited(spark, path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def source_table(
    spark: SparkSession, path: str, source: str, languages: dict[str, str] | None = None, names: dict[str, str] | None = None, drop: list[str] = ()
) -> DataFrame:
    """A table tagged, renamed and pruned, in that order."""
    return tagged(delimited(spark, path), source, languages).withColumnsRenamed(names or {}).drop(*drop)


def with_language(df: DataFrame, languages: dict[str, str]) -> DataFrame:
    """language: that of the source, else the source, else ``unknown``."""
    known = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv]) if languages else None
    return df.withColumn("language", F.coalesce(*([F.try_element_at(known, F.col("source"))] if known is not None else []), F.col("source"), F.lit("unknown")))


def crowd_splits(spark: SparkSession, paths: dict[str, str], listing: DataFrame | None = None) -> DataFrame:
    """client_id, path, sentence and split of the files given by split; rows whose audio is not listed are dropped."""
    out = None
    for split, path in paths.items():
        df = spark.read.csv(path, header=True, sep="\t", mode="PERMISSIVE", quote="").select("client_id", "path", "sentence").withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out if listing is None else out.join(listing.select(F.col("file").alias("path")), "path", "left_semi")


def _alias(df: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.col(c) for c in names if c in df.columns]
    if not found:
        raise ValueError(f"no column among {', '.join(names)}")
    return F.coalesce(*found)


def transcriptions(spark: SparkSession, path: str) -> DataFrame:
    """audio_id and text of an id-keyed list under any of the known headers; empty texts go, the last of an id stays."""
    df = delimited(spark, path)
    audio_id = F.regexp_replace(F.trim(_alias(df, ID_ALIASES)), "^STE-?", "").alias("audio_id")
    rows = df.select(audio_id, F.trim(_alias(df, TEXT_ALIASES)).alias("text"), _file_order().alias("_pos"))
    return last_of_each(rows.filter("audio_id <> '' and text <> ''"), ["audio_id"], ["_pos"]).drop("_pos")


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """audio_filename, key, sentence of a mapping file, trimmed; rows without a name go, the last of a name stays."""
    df = spark.read.csv(path, header=True, sep="\t", quote="")
    cols = [F.trim(F.col(c)).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("audio_filename", "key", "sentence")]
    rows = df.select(*cols, _file_order().alias("_pos")).filter("audio_filename <> ''")
    return last_of_each(rows, ["audio_filename"], ["_pos"]).drop("_pos")


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """file, stem, parent, grandparent, ending, length of all files under a folder, without reading them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    part = lambda i: F.try_element_at(F.split("path", "/"), F.lit(-i))
    stem, ending = F.regexp_replace(part(1), "\\.[^.]*$", ""), F.lower(F.regexp_extract(part(1), "\\.([^.]*)$", 1))
    folders = part(2).alias("parent"), part(3).alias("grandparent")
    return f.select("path", part(1).alias("file"), stem.alias("stem"), *folders, ending.alias("ending"), "length")


def speakers(files: DataFrame, prefix: str = "loc_") -> DataFrame:
    """The speaker of each file: its folder if that has the prefix, else ``unknown``."""
    return files.withColumn("speaker_id", F.when(F.startswith("parent", F.lit(prefix)), F.col("parent")).otherwise("unknown"))


def first_match(wanted: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """wanted (stem) with the path of the first match over folders, then over endings."""
    rank = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), c)
    good = files.filter(F.col("parent").isin(folders) & F.col("ending").isin(list(ENDINGS)))
    good = good.select(F.col("stem").alias("_s"), "path", F.struct(rank(F.col("parent"), folders), rank(F.col("ending"), ENDINGS)).alias("_o"))
    best = good.groupBy("_s").agg(F.min_by("path", "_o").alias("path"))
    return wanted.join(best, F.col("stem") == F.col("_s"), "left").drop("_s")


def segment_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """stem, begin, stop, label of the time-aligned segments under a folder."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    lines = lines.select(F.regexp_extract(F.input_file_name(), "([^/]*)\\.[^./]*$", 1).alias("stem"), "value")
    return segments(lines, "value").drop("value")


def sentence_files(spark: SparkSession, root: str, pattern: str = "*.TXT") -> DataFrame:
    """stem and text of sentence files, without the two leading numbers."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return lines.select(F.regexp_extract(F.input_file_name(), "([^/]*)\\.[^./]*$", 1).alias("stem"), spoken_text(F.col("value")).alias("text"))


def with_sidecars(files: DataFrame, phones: DataFrame, words: DataFrame, sentences: DataFrame) -> DataFrame:
    """Files with their phones, words and text by stem; without a sentence file the words make the text."""

    def joined(rows: DataFrame, name: str) -> DataFrame:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("begin", "label"))), lambda r: r["label"])
        return rows.groupBy(F.col("stem").alias(f"_{name}")).agg(in_order.alias(name))

    out = files.join(joined(phones, "phonemes"), F.col("stem") == F.col("_phonemes"), "left")
    out = out.join(joined(words, "words"), F.col("stem") == F.col("_words"), "left")
    out = out.join(sentences.select(F.col("stem").alias("_t"), "text"), F.col("stem") == F.col("_t"), "left")
    return out.withColumn("transcription", F.coalesce("text", F.array_join("words", " "), F.lit(""))).drop("_phonemes", "_words", "_t", "text")


def stored_graph(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Node and edge tables of a graph that ``sinks.store_graph`` wrote, by name."""
    names = [r.parent for r in listing(spark, root, "*.parquet").select("parent").distinct().collect()]  # one a table
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def in_order(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("audio_path")))
