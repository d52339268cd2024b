"""Sources, sinks and contracts (A1-A9): request CSV, submission CSV, assessment
JSONL, run status JSON.

Row order is data here (the submission must follow the input order), so every
reader assigns ``original_index`` from file position without a sort: a row's
place within its split plus the rows of the splits before it, in the order of
file path and block start.  The splits' counts are a small table, joined.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.functions.text import unicode_strip

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}


class ContractError(ValueError):
    """A file or table breaks the input/output contract."""


def with_file_order(df: DataFrame, name: str = "original_index") -> DataFrame:
    """Dense 0-based row index of a file source, in the order of (file, block, row)."""
    split = ["_file", "_block"]
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_row"))
    splits = df.groupBy(*split).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = splits.select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return df.join(offsets, split).withColumn(name, F.col("_offset") + F.col("_row") - F.col("_first")).drop(
        *split, "_row", "_first", "_offset")


# -------------------------------------------------------------------- A1/A2
def _plain(path: str) -> str:
    """A path without its scheme, to compare the two ways in which Spark and users write it."""
    local = os.path.abspath(path) if "://" not in path and not path.startswith("file:") else path
    return re.sub(r"^[a-zA-Z0-9+.-]+:/*", "/", local).rstrip("/")


def discover_csv(spark: SparkSession, root: str) -> str:
    """A1: ``<root>/dataset.csv`` first, then other ``*.csv`` (any case) by path;
    the first whose header is readable and has ``id`` and a text column wins.

    Candidates are looked at one after another until one fits; files are listed, not read."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.[cC][sS][vV]").load(root).select("path"))
    preferred = _plain(root) + "/dataset.csv"
    first = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/") == preferred
    for row in listing.orderBy(first.desc(), "path").toLocalIterator():
        header = spark.read.text(row.path).limit(1).collect()
        # the text reader puts U+FFFD where bytes aren't UTF-8
        if header and "\ufffd" not in header[0].value and resolve_columns(header[0].value, strict=False):
            return row.path
    raise ContractError(f"no CSV with an id and a question/query column under {root}")


def resolve_columns(header_line: str, strict: bool = True) -> dict | None:
    """A2: header -> {'id': position, 'text': position}; names stripped and lowercased,
    a repeated name resolves to its last position; text is ``question`` else ``query``."""
    import csv
    names = next(csv.reader([header_line.lstrip("\ufeff")]), [])
    pos = {}
    for i, n in enumerate(names):
        pos[n.strip().lower()] = i
    text = pos.get("question", pos.get("query"))
    if "id" not in pos or text is None:
        if strict:
            raise ContractError("input CSV needs an id column and a question (or query) column")
        return None
    return {"id": pos["id"], "text": text, "width": len(names)}


# ------------------------------------------------------------------------ A3
def has_line_breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted CSV value has a line break: some line then has an odd number of quotes, and only then."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_requests(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """A3: ``original_index, id, query`` from a request CSV (quoted newlines, BOM,
    trimmed values).  No rows and a blank id are errors; the latter names its 1-based row.

    A quoted text with a line break keeps Spark from splitting a file, so one task reads
    it whole.  A first pass over the lines finds out whether there is such a text; without
    one, a large file is read by many tasks.  ``multiline`` says so beforehand and spares the pass."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ContractError(f"{path} is empty")
    cols = resolve_columns(first[0].value)
    multiline = has_line_breaks_in_quotes(spark, path) if multiline is None else multiline
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(cols["width"])])
    raw = spark.read.options(**CSV_OPTIONS | {"multiLine": str(multiline).lower()}).schema(schema).csv(path)
    df = with_file_order(raw).select(
        "original_index", unicode_strip(F.col(f"c{cols['id']}")).alias("id"),
        unicode_strip(F.col(f"c{cols['text']}")).alias("query"))
    state = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id") == "", F.col("original_index"))).alias("bad")).first()
    if not state.n:
        raise ContractError(f"{path} has no rows")
    if state.bad is not None:
        raise ContractError(f"blank id at CSV row {state.bad + 2}")
    return df


def read_pair_table(spark: SparkSession, path: str, text_column: str) -> DataFrame:
    """``original_index, id, <text_column>`` from a CSV that must have both columns."""
    first = spark.read.text(path).limit(1).collect()
    import csv
    names = [n.strip() for n in next(csv.reader([first[0].value.lstrip("\ufeff")]), [])] if first else []
    if "id" not in names or text_column not in names:
        raise ContractError(f"{path} must contain id,{text_column}")
    schema = StructType([StructField(n if n else f"c{i}", StringType()) for i, n in enumerate(names)])
    raw = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    if raw.isEmpty():
        raise ContractError(f"{path} has no rows")
    return with_file_order(raw).select("original_index", "id", text_column)


# ------------------------------------------------------------------- A4/A5
def _files(spark: SparkSession, path: str):
    """Hadoop's view of a path: the file system and a maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap of ``write_submission`` that was cut off: afterwards ``path`` is the old or the new output, whole.

    New output lies in ``<path>.new`` until it takes the place, the old one in ``<path>.old`` meanwhile."""
    fs, at = _files(spark, path)
    path = path.rstrip("/")
    here, new, old = at(path), at(f"{path}.new"), at(f"{path}.old")
    if not fs.exists(here):
        if fs.exists(at(f"{path}.new/_SUCCESS")):
            fs.rename(new, here)
        elif fs.exists(old):
            fs.rename(old, here)
    if fs.exists(here):
        fs.delete(old, True)


def _swap(spark: SparkSession, path: str) -> None:
    """Put ``<path>.new`` in the place of ``path``: rename, rename, delete.  ``recover`` goes on from any point."""
    fs, at = _files(spark, path)
    if fs.exists(at(path)) and not fs.rename(at(path), at(f"{path}.old")):
        raise OSError(f"could not move {path} away")
    if not fs.rename(at(f"{path}.new"), at(path)):
        raise OSError(f"could not move {path}.new to {path}")
    fs.delete(at(f"{path}.old"), True)


def write_submission(df: DataFrame, path: str, expected: int | None = None, single_file: bool = False, files: int | None = None) -> int:
    """A4: ``id,response`` CSV in ``original_index`` order, CRLF lines, minimal quoting.

    Blank responses, count mismatches and indexes that are not 0 to n - 1 are errors.  A folder
    of parts in order by default; ``single_file`` sends all rows through one task.

    The index is dense, so it says which of ``files`` parts a row belongs to: rows are dealt by it
    and sorted within their part, without the sampling job of a range sort.  With ``expected`` the
    input is computed once; all checks are observed by the write.  The rows go to ``<path>.new``
    and take the place of ``path`` when they are complete and right: a failed job leaves the old
    output as it was, and one that was cut off while they were swapped is mended by ``recover``,
    which the next write or read does first.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    recover(spark, path)
    n = df.count() if expected is None else expected
    parts = 1 if single_file else files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = F.col("original_index")
    part = F.least(F.greatest(F.floor(index * parts / max(n, 1)), F.lit(0)), F.lit(parts - 1)).cast("int")
    rows = df.select("original_index", "id", "response").repartitionById(parts, part).sortWithinPartitions("original_index")
    seen = Observation()
    blank = F.struct("original_index", F.col("id").alias("id"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"),
                        F.sum(index.cast("decimal(38,0)")).cast("string").alias("total"),
                        F.min(F.when(unicode_strip("response") == "", blank)).alias("blank"))
    rows.select("id", "response").write.mode("overwrite").option("header", "true").option("escape", '"').option(
        "quote", '"').option("lineSep", "\r\n").csv(f"{path}.new")
    got, wrong = seen.get, None
    if got["n"] != n:
        wrong = f"submission has {got['n']} rows, expected {n}"
    elif got["blank"] is not None:
        wrong = f"blank response for id {got['blank']['id']}"
    elif n and (got["low"], got["high"], int(got["total"])) != (0, n - 1, n * (n - 1) // 2):
        wrong = f"submission rows are not numbered 0 to {n - 1}"
    if wrong:
        fs, at = _files(spark, path)
        fs.delete(at(f"{path}.new"), True)
        raise ContractError(wrong)
    _swap(spark, path)
    return n


#: Positions of a block whose rows are compared by one digest.
BLOCK = 1 << 16


def _blocks(rows: DataFrame, block: int, *more) -> DataFrame:
    """Count and digest of (position, id) for each block of positions, added up before the exchange."""
    h = F.xxhash64("original_index", "id")
    return rows.groupBy(F.floor(F.col("original_index") / block).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("id", "original_index")).alias("mix"), *more)


def _differing(requests: DataFrame, submission: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of both sides joined, with ``same``; and the rows of the blocks that differ, joined on position."""
    blank = F.count_if(unicode_strip("response") == "").alias("blank")
    r, s = _blocks(requests, block), _blocks(submission, block, blank)
    both = r.alias("r").join(s.alias("s"), F.col("r.block").eqNullSafe(F.col("s.block")), "full_outer").select(
        F.coalesce("r.block", "s.block").alias("block"), F.coalesce("r.n", F.lit(0)).alias("requests"),
        F.coalesce("s.n", F.lit(0)).alias("submitted"), F.coalesce("s.blank", F.lit(0)).alias("blank"),
        (F.col("r.n").eqNullSafe(F.col("s.n")) & F.col("r.sum").eqNullSafe(F.col("s.sum")) & F.col("r.mix").eqNullSafe(F.col("s.mix"))).alias("same"))
    odd = both.where(~F.col("same")).select("block")

    def of(rows: DataFrame, name: str) -> DataFrame:
        at = F.floor(F.col("original_index") / block).alias("block")
        return rows.select("original_index", F.col("id").alias(name), at).join(odd, "block", "left_semi").drop("block")

    return both, of(requests, "req_id").join(of(submission, "sub_id"), "original_index", "full_outer")


def validation_report(requests: DataFrame, submission: DataFrame, block: int = BLOCK) -> DataFrame:
    """A5: one-row report of a submission against its requests, by position.

    ``missing`` = request rows without a submission row, ``extra`` = the
    reverse, ``id_mismatch`` = same position, different id, ``blank_response``.

    Both sides are reduced to a count and a digest for each block of positions; only
    rows of blocks that differ are joined, as position and id.  Responses are tested
    for blanks where they are read, so no text is ever exchanged.
    """
    both, odd = _differing(requests, submission, block)
    whole = both.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("submitted"), F.lit(0)).alias("submitted"),
                     F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_response"))
    parts = odd.agg(F.count_if(F.col("sub_id").isNull()).alias("missing"), F.count_if(F.col("req_id").isNull()).alias("extra"),
                    F.count_if(F.col("req_id") != F.col("sub_id")).alias("id_mismatch"))
    return whole.crossJoin(parts).select("requests", "submitted", "missing", "extra", "id_mismatch", "blank_response")


def first_violation(requests: DataFrame, submission: DataFrame, block: int = BLOCK) -> DataFrame:
    """A5: the first position that breaks the contract -- ``original_index``, ``what``, ``id`` -- or no row."""
    _both, odd = _differing(requests, submission, block)
    what = F.when(F.col("sub_id").isNull(), "missing").when(F.col("req_id").isNull(), "extra").when(
        F.col("req_id") != F.col("sub_id"), "id_mismatch")
    found = odd.select("original_index", what.alias("what"), F.coalesce("req_id", "sub_id").alias("id")).where("what is not null")
    blank = submission.where(unicode_strip("response") == "").select("original_index", F.lit("blank_response").alias("what"), "id")
    first = found.unionByName(blank).agg(F.min(F.struct("original_index", "what", "id")).alias("v"))
    return first.where("v is not null").select("v.*")


def validate_submission(requests: DataFrame, submission: DataFrame, header: list[str] | None = None) -> int:
    """A5 strict: raise on the first violation, else return the record count."""
    if header is not None and header != ["id", "response"]:
        raise ContractError("submission header must be exactly id,response")
    rep = validation_report(requests, submission).collect()[0]
    if not (rep.missing or rep.extra or rep.id_mismatch or rep.blank_response):
        return rep.requests
    v = first_violation(requests, submission).first()
    where = f"first at row {v.original_index + 2}, id {v.id}: {v.what}"
    if rep.missing or rep.extra:
        raise ContractError(f"submission count {rep.submitted} != input count {rep.requests}; {where}")
    if rep.id_mismatch:
        raise ContractError(f"submission ids/order do not match input; {where}")
    row = submission.filter(unicode_strip("response") == "").agg(F.min(F.struct("original_index", "id")).alias("r")).first().r
    raise ContractError(f"submission has a blank response in row {row.original_index + 2}, id {row.id}")


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    recover(spark, path)
    first = spark.read.text(path).limit(1).collect()
    import csv
    header = [n for n in next(csv.reader([first[0].value.lstrip("\ufeff")]), [])] if first else []
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
    raw = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    df = with_file_order(raw)
    if len(header) >= 2:
        df = df.select("original_index", F.col("c0").alias("id"), F.col("c1").alias("response"))
    return df, header


# ------------------------------------------------------------------- A6/A7/A8
ASSESSMENT_SCHEMA = ("id string, query string, response string, label string, harmful_probability double, "
                     "raw_error string, guard_query_total_tokens int, guard_query_visible_tokens int, "
                     "guard_response_total_tokens int, guard_response_token_budget int, estimated_visible_tokens int")


def write_assessments(df: DataFrame, path: str) -> None:
    """A6 sink: one JSON object per line."""
    df.write.mode("overwrite").json(path)


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """A6 source: JSONL with an explicit schema; blank lines are skipped, broken ones and rows without an id fail."""
    rows = with_file_order(spark.read.option("mode", "FAILFAST").schema(ASSESSMENT_SCHEMA).json(path), "position")
    return rows.withColumn("id", F.coalesce("id", F.raise_error(F.lit(f"an assessment in {path} has no id")).cast("string")))


def last_by_id(assessments: DataFrame, position: str = "position") -> DataFrame:
    """The last row per id (file position order), partial aggregation map-side."""
    cols = [c for c in assessments.columns if c not in ("id", position)]
    latest = assessments.groupBy("id").agg(F.max_by(F.struct(*cols), F.col(position)).alias("_a"))
    return latest.select("id", "_a.*")


def join_assessments_by_id(requests: DataFrame, assessments: DataFrame, strict: bool = True) -> DataFrame:
    """H9: left join on id (last row wins); strict mode fails when any request has none."""
    latest = last_by_id(assessments)
    j = requests.join(latest, "id", "left")
    if strict:
        missing = j.filter(F.col("label").isNull()).count()
        if missing:
            raise ContractError(f"classifier output is missing {missing} ids")
    return j.withColumn("label", F.lower(F.coalesce("label", F.lit("unknown"))))


def write_run_status(spark: SparkSession, report: dict, path: str) -> bool:
    """Pretty, key-sorted JSON status; failure only warns (returns False)."""
    try:
        text = json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return True
    except Exception as exc:  # noqa: BLE001 - status is best effort
        import warnings
        warnings.warn(f"could not write run status: {exc}")
        return False


def require_nonempty(drafts: DataFrame, text: str = "text", limit: int = 20) -> None:
    """Hard failure when any draft is blank, naming up to ``limit`` ids."""
    blank = drafts.filter(unicode_strip(text) == "")
    ids = [r.id for r in blank.select("id").limit(limit).collect()]
    if ids:
        raise ContractError(f"blank model drafts for ids: {', '.join(ids)}")
