"""Readers of log lines, dictionaries, tags, metrics and numeric tables, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as T
from ..functions import lexer
from ..functions import text as X


def read_lines(spark: SparkSession, path: str, max_len: int = 0, stream: bool = False, max_files: int = 0) -> DataFrame:
    """``line``; longer ones are cut at ``max_len`` characters (0: never). A stream takes at most ``max_files`` files a batch (0: any number)."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.text(path)
    value = F.col("value") if not max_len else F.substring("value", 1, max_len)
    return rows.select(value.alias("line"))


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 54321, max_len: int = 0) -> DataFrame:
    """A stream of lines from a TCP server, for trials: it can't be replayed."""
    rows = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return rows.select((F.substring("value", 1, max_len) if max_len else F.col("value")).alias("line"))


def synthetic(spark: SparkSession, n: int = 1_000_000, host: str = "test_host", body: str = "This is a test.", epoch_us: int = 1431388800123456) -> DataFrame:
    """``epoch_us, host, body``: n equal messages."""
    return spark.range(n).select(F.lit(epoch_us).alias("epoch_us"), F.lit(host).alias("host"), F.lit(body).alias("body"))


def with_priority(lines: DataFrame) -> DataFrame:
    """Lines as a log daemon would forward them: with ``<1>1 `` before an ISO time, ``<1>`` before others."""
    iso = F.col("line").rlike(r"^\d{4}-\d\d-\d\dT")
    return lines.select(F.when(F.col("line").rlike("^<"), F.col("line")).otherwise(F.concat(F.when(iso, "<1>1 ").otherwise("<1>"), "line")).alias("line"))


def parsed(lines: DataFrame, default_host: str | Column = "localhost", year: int | None = None, clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """Messages ``epoch_us, host, body, format`` of ``lines(line)``, and the lines without a known header."""
    line = X.sanitize(F.col("line")) if clean else F.col("line")
    rows = lines.select("line", lexer.header(line).alias("h"))
    host = F.coalesce("h.host", F.lit(default_host) if isinstance(default_host, str) else default_host)
    good = rows.where("h is not null").select(lexer.epoch_us(F.col("h.ts"), year).alias("epoch_us"), host.alias("host"), F.col("h.body").alias("body"), F.col("h.format").alias("format"))
    return good, rows.where("h is null").select("line")


def read_dictionary(spark: SparkSession, path: str, types: str) -> DataFrame:
    """``tkn_text, tkn_id, type_mask, seq`` of a file of ``TEXT [ID]`` lines; ``#`` begins a comment, over-long texts are left out.

    One id for several texts makes them aliases; ``last_of_alias`` tells which one shows. A file of type TYPE with ids
    defines types: each such token has the bit of its id too (see ``user_types``).
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\s*#.*$", "").alias("v"), F.monotonically_increasing_id().alias("seq")).where("trim(v) <> ''")
    parts = F.split(F.trim("v"), r"\s+")
    number, mask = F.get(parts, F.lit(1)).cast("long"), F.lit(T.parse_types(types)).cast("long")
    if types == "TYPE":
        mask = mask.bitwiseOR(F.when(number.between(1, 63), F.call_function("shiftleft", F.lit(1).cast("long"), (number - 1).cast("int"))).otherwise(F.lit(0).cast("long")))
    return rows.select(F.get(parts, F.lit(0)).alias("tkn_text"), number.alias("tkn_id"), mask.alias("type_mask"), "seq").where("length(tkn_text) <= 1023")


def user_types(dictionary: DataFrame) -> DataFrame:
    """``type_name, type_id`` of the tokens that define a type: ``NAME`` or ``_NAME_``, numbered by its id without the bit 0x80."""
    known = dictionary.where(X.has_mask(F.col("type_mask"), "TYPE") & F.col("tkn_id").isNotNull())
    return known.select(F.regexp_replace("tkn_text", "^_(.+)_$", "$1").alias("type_name"), F.col("tkn_id").bitwiseAND(F.lit(~0x80).cast("long")).alias("type_id")).distinct()


def read_typed_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``tkn_text, type_mask`` of ``TEXT TYPE[,TYPE]`` lines. An unknown type name is an error."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    unknown = F.filter(F.split(F.col("p")[1], r"[,|]"), lambda name: ~name.isin(*T.NUMBER))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown token type: "), F.get(unknown, F.lit(0))))).otherwise(F.col("p")[0])
    bit = F.lit(0).cast("long")
    for name, number in T.NUMBER.items():
        bit = bit.bitwiseOR(F.when(F.array_contains(F.split(F.col("p")[1], r"[,|]"), name), F.lit(1 << (number - 1))).otherwise(F.lit(0)).cast("long"))
    return rows.select(checked.cast("string").alias("tkn_text"), bit.alias("type_mask")).groupBy("tkn_text").agg(F.bit_or("type_mask").alias("type_mask"))


def last_of_alias(dictionary: DataFrame) -> DataFrame:
    """``tkn_id, tkn_text``: of the texts of one id the one that came last."""
    return dictionary.where("tkn_id is not null").groupBy("tkn_id").agg(F.max_by("tkn_text", "seq").alias("tkn_text"))


def conflicting_ids(dictionary: DataFrame) -> DataFrame:
    """Texts that were given several ids."""
    return dictionary.groupBy("tkn_text").agg(F.countDistinct("tkn_id").alias("n")).where("n > 1")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """``ptn_id, attr_type, attr_value`` of ``PTN_ID TYPE VALUE`` lines."""
    pattern = r"^\s*(\d+)\s+(\S+)\s+(.*?)\s*$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).cast("long").alias("ptn_id"), part(2).alias("attr_type"), part(3).alias("attr_value"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``sec, comp_id, value, name`` of a table whose first column is the second, the fourth the host, and metrics follow from the sixth on."""
    rows = spark.read.csv(path, header=True)
    names = rows.columns[5:]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value")) for n in names)))
    return rows.select(F.col(f"`{rows.columns[0]}`").cast("long").alias("sec"), F.col(f"`{rows.columns[3]}`").cast("long").alias("comp_id"), pairs.alias("m")).select("sec", "comp_id", "m.value", "m.name")


def read_numeric(spark: SparkSession, path: str, include: list[int] | None = None, exclude: list[int] | None = None) -> DataFrame:
    """A table with a header, its chosen columns (by place from 0) as doubles."""
    rows = spark.read.csv(path, header=True)
    keep = [c for i, c in enumerate(rows.columns) if (include is None or i in include) and i not in (exclude or [])]
    return rows.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in keep))


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def formatted(rows: DataFrame, template: str) -> DataFrame:
    """``text`` of each row by a template with ``%(field)s``."""
    import re

    fields = re.findall(r"%\((\w+)\)s", template)
    return rows.select(F.format_string(re.sub(r"%\(\w+\)s", "%s", template), *(F.col(f).cast("string") for f in fields)).alias("text"))
