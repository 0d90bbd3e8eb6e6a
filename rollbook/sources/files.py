"""Source files as rows: identity, digests, first record, and what changed since the last load.

All of it is read by Spark's own sources, so a path may be of any file system that Spark reads.
Files are listed by the ``binaryFile`` source, whose content column is pruned. Headers and the
digests of large files come from text scans, which split a file among tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.contract import Contract, Provenance
from rollbook.operators.profile import row_digest
from rollbook.staging import stage

#: Files up to this size have a plain SHA-256, for which one task holds the content (128 MB).
WHOLE_BYTES = 1 << 27
#: Nodes of a hash tree that make one node of the next level.
FAN_OUT = 1024
Paths = str | list[str]


class SourceError(RuntimeError):
    """A source file cannot be loaded; ``issues`` has the files concerned, if they are known."""

    def __init__(self, message: str, issues: DataFrame | None = None) -> None:
        super().__init__(message)
        self.issues = issues


def _files(spark: SparkSession, path: Paths, source: str = "binaryFile", **options) -> DataFrame:
    try:
        return spark.read.format(source).options(**options).load(path)
    except AnalysisException as error:
        raise SourceError(f"Source was not found at {path}.") from error


def manifest(spark: SparkSession, path: Paths, provenance: Provenance | None = None) -> DataFrame:
    """``path, length, modified`` per file, stamped with where the data was published.

    Spark gives no row for a file without content; :func:`header_issues` counts those.
    """
    files = _files(spark, path).select("path", "length", F.col("modificationTime").alias("modified"))
    if provenance is None:
        return files
    stamps = vars(provenance)
    return files.select("*", *(F.lit(value).alias(name) for name, value in stamps.items()))


def changes(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Files that are new, changed or removed against a saved manifest: ``path, change``."""
    now = current.select("path", F.struct("length", "modified").alias("now"))
    then = saved.select("path", F.struct("length", "modified").alias("then"))
    change = (
        F.when(F.col("then").isNull(), "new")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("now") != F.col("then"), "changed")
    )
    joined = now.join(then, "path", "full").select("path", change.alias("change"))
    return joined.filter(F.col("change").isNotNull())


def plain_path(encoded: Column) -> Column:
    """The path of a row's file, as ``_metadata`` has it, in the form in which files are listed."""
    decoded = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:///", "file:/")


def _digest(data: Column) -> Column:
    return F.sha2(data, 256)


def fingerprints(
    spark: SparkSession, path: Paths, whole_bytes: int | None = WHOLE_BYTES
) -> DataFrame:
    """``path, length, sha256`` per file; null for files of more than ``whole_bytes``.

    A plain SHA-256 needs the bytes in order, so one task has the whole content. The tree of
    :func:`tree_fingerprints` has no such limit. Files are told apart before they are opened.
    With None every file has its digest, for which one task is given the lines in order and holds
    a few pieces of them at a time. Files must not be compressed; where the lines do not add up to
    the length of a file, an error is raised. A file without a line has no row.
    """
    if whole_bytes is None:
        return _line_fingerprints(spark, path)
    files = _files(spark, path)
    small = files.where(F.col("length") <= whole_bytes)
    large = files.where(F.col("length") > whole_bytes)
    return small.select("path", "length", _digest(F.col("content")).alias("sha256")).unionByName(
        large.select("path", "length", F.lit(None).cast("string").alias("sha256"))
    )


def _line_fingerprints(spark: SparkSession, path: Paths) -> DataFrame:
    """``path, length, sha256`` of files of any size.

    All tasks read lines and join neighbours to pieces; only pieces move to the task that digests
    their file. A scan leaves out a byte order mark and whether the last line has an end; the
    length of the file tells both.
    """
    text = _files(spark, path, "text", lineSep="\n")
    lines = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").cast("binary").alias("piece"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring lines of one block of a file, up to about 1 MB, as one row."""
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = set(range(0, n, max(1, (n << 20) // max(1, batch.nbytes))))
            for name in ("path", "block"):
                values = batch.column(name)
                other = pc.not_equal(values.slice(1), values.slice(0, n - 1))
                starts.update(k + 1 for k in pc.indices_nonzero(other).to_pylist())
            cuts = pa.array([*sorted(starts), n], pa.int32())
            content = batch.column("piece")
            end = pa.scalar(b"\n", content.type)
            joined = pc.binary_join(pa.ListArray.from_arrays(cuts, content), end)
            yield batch.take(cuts.slice(0, len(cuts) - 1)).set_column(4, "piece", joined)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest the files of a task one after the other, without and with a byte order mark."""
        file, length, size, plain, marked = None, 0, 0, None, None

        def close() -> pa.RecordBatch:
            # What the file has beyond lines that all have an end: -1 for the last one's end,
            # 3 for the mark.
            more = length - size
            if more not in (-1, 0, 2, 3):
                raise ValueError(f"{file} has {length} bytes, but {size} in its lines.")
            found = plain if more <= 0 else marked
            if more in (0, 3):
                found.update(b"\n")
            columns = [[file], [length], [found.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        names = ["path", "length", "sha256"]
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True)
            for (name, total), piece in zip(keys, batch.column("piece"), strict=True):
                if name != file:
                    if file is not None:
                        yield close()
                    file, length, size = name, total, 0
                    plain, marked = hashlib.sha256(), hashlib.sha256(b"\xef\xbb\xbf")
                else:
                    plain.update(b"\n")
                    marked.update(b"\n")
                content = piece.as_buffer()
                plain.update(content)
                marked.update(content)
                size += len(content) + 1
        if file is not None:
            yield close()

    pieces = lines.mapInArrow(join, lines.schema).repartition("path")
    digests = pieces.sortWithinPartitions("path", "block", "at").mapInArrow(
        digest, "path string, length long, sha256 string"
    )
    return digests.withColumn("path", plain_path(F.col("path")))


def file_lines(spark: SparkSession, path: Paths) -> DataFrame:
    """``path, n, digest``: the SHA-256 of every line of every file, lines numbered from 0.

    A line ends with a line feed, which it does not include; the last one may have none. The
    tasks that share a file number their own lines; what lies before them is added up from one
    count for each block of a file.
    """
    text = _files(spark, path, "text", lineSep="\n")
    lines = text.select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        _digest(F.col("value").cast("binary")).alias("digest"),
    )
    lines = stage(lines).frame
    blocks = lines.groupBy("path", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("lines")
    )
    earlier = Window.partitionBy("path").orderBy("block")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    # Written, so that their size is known when they are joined and lines need not move by block.
    blocks = stage(blocks).frame
    number = F.col("before") + F.col("at") - F.col("first")
    return lines.join(blocks, ["path", "block"]).select("path", number.alias("n"), "digest")


def one_file(lines: DataFrame, key: str, path: str) -> str:
    """Write the column ``line`` as one text file in the order of ``key``, and return its folder.

    All tasks read the table and make its lines; only lines and keys reach the task that writes.
    Rows of one key stay in the order in which they are read.
    """
    read = lines.withColumn("_read", F.monotonically_increasing_id())
    read.repartition(1).sortWithinPartitions(key, "_read").select("line").write.text(path)
    return path


def tree_fingerprints(spark: SparkSession, path: Paths, fan_out: int = FAN_OUT) -> DataFrame:
    """``path, lines, tree``: an ordered hash tree over the lines of every file, of any size.

    The leaves are the digests of the lines (:func:`file_lines`). ``fan_out`` neighbours make a
    node, whose digest is that of their digests in order, as hexadecimal text; this goes on until
    a file has one node. Neither the tasks nor the size of the splits change it. Compressed files
    are digested by their text, and files without content have no row.
    """
    nodes = file_lines(spark, path)
    sizes = stage(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))).frame
    most = sizes.agg(F.max("lines")).first()[0] or 1
    nodes = nodes.join(sizes, "path")
    width = 1
    while width < most:
        # A node of a level is the list of at most fan_out nodes.
        level = nodes.groupBy("path", "lines", F.floor(F.col("n") / fan_out).alias("n")).agg(
            F.sort_array(F.collect_list(F.struct("n", "digest"))).alias("below")
        )
        joined = F.array_join(F.transform("below", lambda x: x["digest"]), "")
        alone = F.col("lines") <= width
        nodes = level.select(
            "path",
            "lines",
            "n",
            F.when(alone, F.col("below")[0]["digest"])
            .otherwise(_digest(joined.cast("binary")))
            .alias("digest"),
        )
        width *= fan_out
    return nodes.select("path", "lines", F.col("digest").alias("tree"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and the sum of row digests: independent of order, files and partitions.

    A sum, unlike exclusive or, also sees a row that was doubled. The four 64-bit words of the
    digests are summed apart, so that no part of them is left out.
    """
    hexadecimal = F.hex(row_digest(df))
    words = [F.conv(F.substring(hexadecimal, at, 16), 16, 10) for at in (1, 17, 33, 49)]
    sums = [F.sum(word.cast("decimal(20,0)")).cast("string") for word in words]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.concat_ws(" ", *sums).alias("digest_sum")
    )


#: A field with the comma before it; a quoted one may hold commas and doubled quotes.
_FIELD = r',(?:\s*+"(?:[^"]++|"")*+(?:"[^,]*+|$)|[^,]*+)'


def _names(line: Column) -> Column:
    """The fields of the first line of a delimited file, quotes taken off."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(0))

    def bare(field: Column) -> Column:
        text = F.substr(field, F.lit(2))
        inner = F.regexp_replace(text, r'^\s*"|"[^",]*$', "")
        return F.when(text.rlike(r'^\s*"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(text)

    return F.transform(fields, bare)


def headers(spark: SparkSession, path: Paths) -> DataFrame:
    """``path, names, error``: the first line of every file that has one.

    A header that goes on behind its first line, in quotes, is given up to there, with the line
    break in its last name. One text scan; one row for each file and task is shuffled.
    """
    text = _files(spark, path, "text")
    first = (
        text.where(F.col("_metadata.file_block_start") == 0)
        .select(plain_path(F.col("_metadata.file_path")).alias("path"), "value", F.monotonically_increasing_id().alias("at"))
        .groupBy("path")
        .agg(F.min_by("value", "at").alias("line"))
    )
    good = F.is_valid_utf8("line")
    line = F.regexp_replace(F.when(good, F.col("line")), "^\uFEFF", "")
    goes_on = F.regexp_count(line, F.lit('"')) % 2 == 1
    line = F.when(goes_on, F.concat(line, F.lit('\n"'))).otherwise(line)
    error = F.when(~good, F.lit("the header is no UTF-8"))
    return first.select("path", _names(line).alias("names"), error.alias("error"))


def header_issues(spark: SparkSession, path: Paths, contract: Contract) -> DataFrame:
    """Files whose header breaks the contract: ``path, problem, duplicates, missing, unexpected``.

    Names and their order must equal the contract exactly, case included.
    """
    expected = F.array(*(F.lit(name) for name in contract.columns))
    names = F.col("names")
    problem = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error"))
        .when(names.isNull(), "no header")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate column names")
        .when(F.array_size(F.array_except(expected, names)) > 0, "columns differ")
        .when(F.array_size(F.array_except(names, expected)) > 0, "columns differ")
        .when(names != expected, "column order differs")
    )
    repeated = F.filter(
        F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1
    )
    found = headers(spark, path)
    issues = found.select(
        "path",
        problem.alias("problem"),
        F.sort_array(repeated).alias("duplicates"),
        F.array_except(expected, names).alias("missing"),
        F.array_except(names, expected).alias("unexpected"),
    )
    issues = issues.filter(F.col("problem").isNotNull())
    # A file without content has no row; the number of all files is that of Spark's file index.
    listed = len(_files(spark, path).inputFiles())
    empty = F.lit(listed) - F.count(F.lit(1))
    none = F.array().cast("array<string>")
    missing = manifest(spark, path).agg(empty.alias("n")).filter("n > 0").select(
        F.lit(path if isinstance(path, str) else ", ".join(path)).alias("path"),
        F.concat(F.col("n").cast("string"), F.lit(" files without content")).alias("problem"),
        none.alias("duplicates"),
        expected.alias("missing"),
        none.alias("unexpected"),
    )
    return issues.unionByName(missing)
