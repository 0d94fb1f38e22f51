"""Text formats as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ordered import last_known


#: Lines of a dump that one task looks back over.
CHUNK = 100_000
#: What the headers of a profile dump's sections hold, and how the mapping of a location begins.
SECTIONS = {"sample": "Samples:", "location": "Locations", "mapping": "Mappings"}
MAPPING = "M="


def measurements(spark: SparkSession, path: str, sep: str = ";", kind: str = "decimal(18,2)") -> DataFrame:
    """key, value from key;value lines; files are split by Spark, blank lines skipped, a last line without end kept."""
    return spark.read.schema(f"key string, value {kind}").option("sep", sep).csv(path)


def write_measurements(df: DataFrame, path: str, sep: str = ";") -> None:
    """The two columns of df as key;value lines."""
    df.write.option("sep", sep).csv(path)


def folded(spark: SparkSession, path: str) -> DataFrame:
    """frames, n1, n2 from lines `a;b;c count [count2]`; see parse_folded."""
    return parse_folded(spark.read.text(path))


def _last_word(text: Column) -> tuple[Column, Column]:
    """What stands before the last run of blanks of a text, and the number after it; null if that is no plain number."""
    words = F.split(F.rtrim(text), " ")
    last = F.element_at(words, -1)
    plain = F.translate(last, ".", "")
    digits = (plain != "") & (F.translate(plain, "0123456789", "") == "") & ~last.startswith(".")
    fits = digits & (F.size(words) > 1) & (F.length(last) - F.length(plain) <= 1)
    rest = F.rtrim(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return rest, F.when(fits, last.try_cast("double"))


def parse_folded(lines: DataFrame, line: str = "value") -> DataFrame:
    """frames, n1, n2, ignored of folded lines: with one count n2 is null; a line without a count is marked ignored.

    A count is the number after the last blanks; a frame may hold blanks and digits of its own. Frames of an ignored
    line are null.
    """
    rest, last = _last_word(F.translate(line, "\t", " "))
    before, first = _last_word(rest)
    two = last.isNotNull() & first.isNotNull()
    stack = F.when(two, before).when(last.isNotNull(), rest)
    return lines.select(F.split(stack, ";").alias("frames"), F.coalesce(F.when(two, first), last).alias("n1"), F.when(two, last).alias("n2"), last.isNull().alias("ignored"))


def profile(lines: DataFrame, order: str = "pos", line: str = "value", by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples (loc_ids, n) and names (id, name) of a profile dump with the sections Samples:, Locations and Mappings.

    A sample is `count value: id id ...`, a location `id: address [mapping] name rest`. The section of a line is the last
    header before it, in its chunk of line numbers or an earlier one, so a dump of any length is read by chunks. by: a
    column that tells dumps apart.
    """
    keys = [by] if by else []
    text = F.trim(F.col(line))
    header = F.coalesce(*[F.when(text.contains(mark), name) for name, mark in SECTIONS.items()])
    rows = lines.filter(~F.col(line).startswith("#")).withColumns({"header": header, "_chunk": F.expr(f"`{order}` div {CHUNK}")})
    rows = last_known(rows, keys, "_chunk", [order], "header", "section")
    label, rest = F.trim(F.substring_index(text, ":", 1)), F.trim(F.expr(f"substring(trim(`{line}`), locate(':', trim(`{line}`)) + 1)"))
    body = rows.filter("header IS NULL").filter(text.contains(":")).withColumns({"_label": F.filter(F.split(label, " "), lambda x: x != ""), "_rest": F.filter(F.split(rest, " "), lambda x: x != "")})
    count = F.element_at("_label", 1).try_cast("bigint")
    samples = body.filter((F.col("section") == "sample") & (F.size("_rest") > 0)).select(*keys, F.col("_rest").alias("loc_ids"), count.alias("n")).filter("n IS NOT NULL")
    mapped = F.element_at("_rest", 2).startswith(MAPPING) & (F.size("_rest") > 2)
    name = F.when(mapped, F.try_element_at("_rest", F.lit(3))).otherwise(F.try_element_at("_rest", F.lit(2)))
    names = body.filter((F.col("section") == "location") & (F.size("_rest") > 1)).select(*keys, F.element_at("_label", 1).alias("id"), name.alias("name"))
    return samples, names


def metric_lines(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """metrics, a map from names to values of lines `name: value, name: value`, beside the columns to keep."""
    pairs = F.split(line, r",\s*")
    clean = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, r"^[^:]*:", "")).alias("value")))
    return lines.select(*(keep or []), F.map_from_entries(F.filter(clean, lambda p: p["key"] != "")).alias("metrics"))


def attributes(lines: DataFrame, line: str = "value") -> DataFrame:
    """name, attributes of lines `name<TAB>key=value<TAB>key=value`."""
    parts = F.split(line, "\t")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    pairs = F.transform(rest, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, r"^[^=]*=?", "").alias("value")))
    return lines.select(parts[0].alias("name"), F.map_from_entries(pairs).alias("attributes"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def file_number(name: Column) -> Column:
    """The last number in a file's name."""
    return F.regexp_extract(name, r"(\d+)\D*$", 1).cast("bigint")


def with_file_id(df: DataFrame) -> DataFrame:
    """df with the number in the name of the file that each row came from, so that files sort as numbers."""
    return df.withColumn("file_id", file_number(F.col("_metadata.file_name")))
