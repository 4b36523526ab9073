"""Records of delimited files whose quoted fields may hold line breaks, cut from byte ranges in parallel.

Spark's text source splits large files at lines; whether a line starts inside a quoted field depends on all lines before it.
So every range is followed under both states first (it is a function of two states; lines without quotes change nothing), the functions are
composed in file order, one small row a range, and then each range is cut with its true state. A record that crosses
ranges leaves one piece in each and is joined from them. Lines end with a line feed; a carriage return before it goes.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "file string, at long"


def opens_quote(sep: str) -> re.Pattern:
    """Matches a line, begun outside of quotes, that ends inside a quoted field. Quotes count only where a field starts with
    one; ``""`` inside quotes is one quote; whatever follows a closing quote up to the separator belongs to the field."""
    s = re.escape(sep)
    return re.compile(rf'(?:(?:"(?:[^"]++|"")*+(?:"[^{s}]*+)|[^"{s}][^{s}]*+)?+{s})*+"(?:[^"]++|"")*+\Z')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list, bool]]:
    """((file, at), lines, whether the range ends here) in order; a task may hold several ranges."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf["at"].ne(pdf["at"].shift()) | pdf["file"].ne(pdf["file"].shift())
        cuts = [*key.to_numpy().nonzero()[0].tolist(), len(pdf)]
        lines, files, starts = pdf["value"].tolist(), pdf["file"], pdf["at"]
        for a, b in zip(cuts, cuts[1:]):
            here = (files.iloc[a], int(starts.iloc[a]))
            if held is not None:
                yield held[0], held[1], held[0] != here
            held = (here, lines[a:b])
    if held is not None:
        yield held[0], held[1], True


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """file, value, head (true for the first record of its file): the records of all files of a path, in any order."""
    lines, quoted = _lines(spark, path), opens_quote(sep)

    def follow(batches):
        state, closes, after = (0, 1), False, []       # where a range ends that begins outside, or inside
        for key, part, done in _ranges(batches):
            for line in part:
                if '"' in line:
                    step = (quoted.match(line) is not None, quoted.match('"' + line) is not None)
                    state = (int(step[state[0]]), int(step[state[1]]))
                closes = closes or not state[1]
            if done:
                after.append((*key, *state, closes))
                state, closes = (0, 1), False
        yield pd.DataFrame(after, columns=["file", "at", "outside", "inside", "closes"])

    ranges = sorted(tuple(r) for r in lines.mapInPandas(follow, f"{_COLUMNS}, outside int, inside int, closes boolean").collect())
    begins, last, state, owner = {}, None, 0, None       # per range: its owner of the record that comes in, or None; is it the file's first
    for file, at, outside, inside, closes in ranges:
        if file != last:
            state, owner = 0, None
        begins[file, at] = (owner if state else None, file != last)
        if state:
            state, owner = inside, at if closes else owner
        else:
            state, owner = outside, at
        last = file

    def cut(batches):
        key = None
        for here, part, done in _ranges(batches):
            if here != key:
                key, text = here, []
                came, head = begins[here]
                inside = came is not None
            out = []
            for line in part:
                ends = inside
                if '"' in line:
                    ends = quoted.match('"' + line if inside else line) is not None
                if not ends:
                    line = line.removesuffix("\r")
                if inside or ends:
                    text.append(line)
                if not ends:
                    if came is not None:
                        out.append((key[0], came, key[1], "\n".join(text), False))     # the last piece of a record that came in
                    else:
                        out.append((key[0], key[1], None, "\n".join(text) if inside else line, head))
                        head = False
                    came, text = None, []
                inside = ends
            if done and text:
                out.append((key[0], key[1] if came is None else came, key[1], "\n".join(text), came is None and head))
            yield pd.DataFrame(out, columns=["file", "owner", "piece", "value", "head"], dtype=object)

    pieces = lines.mapInPandas(cut, "file string, owner long, piece long, value string, head boolean")
    whole = pieces.where("piece is null").select("file", "value", "head")
    crossing = pieces.where("piece is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("all"), F.max("head").alias("head"))     # one record's pieces
    return whole.unionByName(crossing.select("file", F.array_join(F.transform("all", lambda p: p["value"]), "\n").alias("value"), "head"))


def parse(reader, values: DataFrame) -> DataFrame:
    """The records (value) read by Spark's CSV source with the options of ``reader``."""
    text = getattr(values.select("value")._jdf, "as")(values.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.csv(text), values.sparkSession)
