"""Delimited text: what a file's text says about its layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that is cut off lines.
SPACES = " \t\n\r\x0b\x0c"
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "space": " "}
#: A number as float() reads it.
NUMBER = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$|^\s*[+-]?([nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def is_number(token: Column) -> Column:
    return F.coalesce(token.rlike(NUMBER), F.lit(False))


def delimiter(text: Column) -> Column:
    """Of the first 20 lines, blanks left out: tab if there is one, else the most frequent, ties in the order , ; space."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    head = F.array_join(lines, "\n")
    count = {n: F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))) for n, d in DELIMITERS.items()}
    most = F.greatest(*count.values())
    return F.when(count["tab"] > 0, "\t").when((most == 0) | (count["comma"] == most), ",").when(count["semicolon"] == most, ";").otherwise(" ")


def tokens_of(line: Column, delimiter_: Column) -> Column:
    """A line's tokens; runs of white space part them if the delimiter is a space."""
    return F.split(line, F.when(delimiter_ == " ", r"\s+").when(delimiter_ == "\t", "\t").otherwise(delimiter_))


def numeric_share(text: Column, delimiter_: Column) -> Column:
    """Share of tokens that are numbers in the first ten lines, blanks left out, of the first 2048 characters; without
    tokens 1, as nothing speaks against numbers."""
    lines = F.slice(F.filter(F.split(F.substring(text, 1, 2048), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), 1, 10)
    tokens = F.flatten(F.transform(lines, lambda x: tokens_of(F.btrim(x, F.lit(SPACES)), delimiter_)))
    plain = F.transform(tokens, lambda x: F.translate(x, "\"'", ""))
    return F.coalesce(F.try_divide(F.size(F.filter(plain, is_number)).cast("double"), F.size(tokens).cast("double")), F.lit(1.0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


#: What a classification says.
WHY = {
    "missing": "File does not exist or is not a file.", "empty": "File is empty (0 bytes).", "unreadable": "File unreadable: Unicode decoding failed.", "binary": "Binary data detected (null bytes present).",
    "unknown": "Unrecognized file extension '%s'. Will attempt custom parsing.", "prose": "Low density of numeric data in preview. Possible high-text metadata file.", "csv": "Standard CSV with comma delimiter.",
    "txt": "Standard delimited TXT file.", "odd": "Delimited data found with non-standard separator '%s' or format.", "path": "Input path does not exist.", "zip": "Failed to extract ZIP.",
}


def classified(rows: DataFrame) -> DataFrame:
    """Adds status and reason to rows (file_path, size, text): Ready, Partially Ready, Research Only or Unsafe, by the first
    rule that holds. Null text: not decodable."""
    rows = rows.withColumn("_by", delimiter(F.col("text")))
    rows = rows.withColumn("_share", numeric_share(F.col("text"), F.col("_by")))
    return rows.withColumn("_c", _classify(F.col("file_path"), F.col("size"), F.col("text"), F.col("_by"), F.col("_share"))).withColumn("status", F.col("_c.status")).withColumn("reason", F.col("_c.reason")).drop("_by", "_share", "_c")


def _classify(path: Column, size: Column, text: Column, by: Column, share: Column) -> Column:
    ext = extension(path)
    rules = [
        (size == 0, "Unsafe", F.lit(WHY["empty"])), (text.isNull(), "Unsafe", F.lit(WHY["unreadable"])), (F.substring(text, 1, 2048).contains("\x00"), "Unsafe", F.lit(WHY["binary"])),
        (~ext.isin(".csv", ".txt", ".tsv"), "Research Only", F.format_string(WHY["unknown"], ext)), (share < 0.1, "Research Only", F.lit(WHY["prose"])),
        ((ext == ".csv") & (by == ","), "Ready", F.lit(WHY["csv"])), ((ext == ".txt") & by.isin("\t", " ", ","), "Ready", F.lit(WHY["txt"])), (F.lit(True), "Partially Ready", F.format_string(WHY["odd"], by)),
    ]
    made = [(c, F.struct(F.lit(status).alias("status"), reason.alias("reason"))) for c, status, reason in rules]
    out = F.when(*made[0])
    for rule in made[1:]:
        out = out.when(*rule)
    return out


def decoded(content: Column) -> Column:
    """(encoding, text): UTF-8 if the bytes are, UTF-16 if they begin with its mark, else Latin-1, which any bytes are."""
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    utf8 = F.is_valid_utf8(content.cast("string"))
    text = F.when(utf8, content.cast("string")).when(marked, F.decode(F.when(marked & ~utf8, content), "UTF-16")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.struct(F.when(utf8, "utf-8").when(marked, "utf-16").otherwise("latin-1").alias("encoding"), text.alias("text"))


def lines_of(texts: DataFrame, delimiter_: str = ",") -> DataFrame:
    """(file, line_no, line, tokens) of the lines that are not blank, by ``delimiter_`` or a column ``delimiter``; one empty
    token at the end is dropped."""
    by = F.col("delimiter") if "delimiter" in texts.columns else F.lit(delimiter_)
    lines = texts.select("file", by.alias("by"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.btrim("line", F.lit(SPACES))).filter("line <> ''")
    tokens = tokens_of(F.col("line"), F.col("by"))
    lines = lines.withColumn("tokens", F.when((F.size(tokens) > 1) & (F.element_at(tokens, -1) == ""), F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens))
    return lines.select("file", "line_no", "line", "tokens")


def modal_columns(lines: DataFrame) -> DataFrame:
    """(file, columns): the most frequent number of tokens, ties by the first seen."""
    per = lines.groupBy("file", F.size("tokens").alias("columns")).agg(F.count("*").alias("c"), F.min("line_no").alias("first"))
    return per.groupBy("file").agg(F.max_by("columns", F.struct("c", -F.col("first"))).alias("columns"))


def data_start(lines: DataFrame) -> DataFrame:
    """(file, start): the first line from which five lines on (or to the end) have the modal number of tokens and at
    least one fewer numbers; 0 if none."""
    good = lines.join(modal_columns(lines), "file").withColumn("ok", (F.size("tokens") == F.col("columns")) & (F.size(F.filter("tokens", is_number)) >= F.col("columns") - 1))
    w = Window.partitionBy("file").orderBy("line_no").rangeBetween(0, 4)
    run = good.withColumn("run", F.min(F.col("ok").cast("int")).over(w))
    return run.groupBy("file").agg(F.coalesce(F.min(F.when(F.col("run") == 1, F.col("line_no"))), F.lit(0)).alias("start"))


#: What the names of columns say.
ID, TIME, SIGNAL = "id|subject|name", "time|timestamp|min|sec|ms|t", "ppg|pulse|pleth|ir|red|ch3|channel 3|signal"


def roles(names: Column, rising: Column, wanted: Column) -> Column:
    """(id_col, timestamp_col, signal_col) of an array of column names, by what they contain; without a time column the
    first of ``rising`` that is not the id. The signal is the ``wanted`` column if there is one of that name; where none tells
    by its name, the last other column, or the last."""
    like = lambda pattern: lambda c: F.lower(c).rlike(pattern)
    id_ = F.get(F.filter(names, like(ID)), 0)
    time = F.coalesce(F.get(F.filter(names, like(TIME)), 0), F.get(F.filter(rising, lambda c: ~c.eqNullSafe(id_)), 0))
    others = F.filter(names, lambda c: ~c.eqNullSafe(id_) & ~c.eqNullSafe(time))
    signal = F.coalesce(F.when(F.array_contains(names, wanted), wanted), F.get(F.filter(others, like(SIGNAL)), 0), F.get(others, F.size(others) - 1), F.get(names, F.size(names) - 1))
    return F.struct(id_.alias("id_col"), time.alias("timestamp_col"), signal.alias("signal_col"))
