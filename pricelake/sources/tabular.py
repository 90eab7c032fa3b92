"""Delimited text and workbook files as tables of text."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelake.functions import text

EXTENSIONS = (".csv", ".tsv", ".txt", ".xls", ".xlsx", ".xlsm", ".xltx")
#: The largest file taken, in bytes.
SIZE_MOST = 25 << 20


def formats(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format, accepted) of files, by their first bytes, extension and size."""
    files = spark.read.format("binaryFile").load(path)
    end = F.lower(F.regexp_extract("path", r"(\.\w+)$", 1))
    return files.select("path", "length", text.detect_format(F.col("content")).alias("format"), (end.isin(*EXTENSIONS) & (F.col("length") <= SIZE_MOST)).alias("accepted"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A file's rows by its kind: text and workbooks are read, other kinds and too large files refused with what to do.

    Gives (row_number, values map), whatever the kind.
    """
    files = formats(spark, path).collect()  # a row a file; every one of them is a file that somebody uploaded
    if not files or not all(x.accepted for x in files):
        raise ValueError(f"{path}: only files of {', '.join(EXTENSIONS)} of at most {SIZE_MOST >> 20} MB are taken")
    of = lambda kind: [x.path for x in files if x.format == kind]
    for kind, what in (("legacy-xls", "a binary workbook of an old kind"), ("html", "a web page under a workbook's name")):
        if of(kind):
            raise ValueError(f"{of(kind)[0]} is {what}; save it as .xlsx or .csv")
    out = spark.createDataFrame([], "row_number long, values map<string,string>")
    if of("xlsx"):
        out = out.union(read_workbooks(spark, of("xlsx")).drop("path"))
    for one in of("text"):  # each has its own delimiter and columns
        rows = read_delimited(spark, one)
        pairs = [y for c in rows.columns if c != "row_number" for y in (F.lit(c), F.col(f"`{c}`"))]
        out = out.union(rows.select("row_number", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("values")))
    return out


def _lines(spark: SparkSession, path: str | list[str], end: str) -> DataFrame:
    """Lines of text files with their file and block; a block's lines come in its order, and keep a carriage return before their end."""
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


class _Quotes:
    """Where records end: a quote opens a field only at its beginning, as spreadsheets write and csv reads it."""

    def __init__(self, mark: str) -> None:
        self.mark = mark

    def after(self, line: str, inside: bool) -> bool:
        """Whether a line that begins inside a quoted field (or with a record) ends inside one."""
        if '"' not in line:
            return inside
        at, n, mark = 0, len(line), self.mark
        while True:
            if not inside:
                while at < n and line[at] == " ":
                    at += 1
                if at < n and line[at] == '"':
                    at += 1
                else:
                    at = line.find(mark, at) + 1
                    if not at:
                        return False
                    continue
            inside = False
            while True:
                at = line.find('"', at) + 1
                if not at:
                    return True
                if line[at : at + 1] != '"':
                    break
                at += 1
            # Behind its quotes a field goes on to the next mark, whatever stands there.
            at = line.find(mark, at) + 1
            if not at:
                return False


def _blocks(lines: DataFrame, mark: str, end: str) -> tuple[dict[str, list[tuple]], dict[str, str]]:
    """file -> its blocks in order: (block, begins inside quotes, number of its first record, ends inside quotes, number after it); file -> its first record.

    Each block is looked at from both states that it may begin in, so blocks don't
    wait for one another; the states and record numbers then follow by a prefix
    scan, over a row a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, inside, records, out, head = _Quotes(mark), None, [False, True], [0, 0], [], []
        for batch in batches:
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != now:
                    if now:
                        out.append((*now, *inside, *records, end.join(head) if records[0] and not now[1] else None))
                    now, inside, records, head = (file, block), [False, True], [0, 0], []
                if not block and not records[0] and (head or line not in ("", "\r")):
                    head.append(line)
                for k in (0, 1):
                    blank = not inside[k] and line in ("", "\r")
                    inside[k] = of.after(line, inside[k])
                    records[k] += not inside[k] and not blank
        if now:
            out.append((*now, *inside, *records, end.join(head) if records[0] and not now[1] else None))
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=names)

    found: dict[str, list[tuple]] = {}
    heads: dict[str, str] = {}
    for r in sorted(lines.mapInArrow(run, _BLOCK).collect(), key=lambda r: (r.file, r.block)):
        if r.head is not None:
            heads[r.file] = r.head
        inside, number = (found[r.file][-1][3], found[r.file][-1][4]) if r.file in found else (False, 1)
        ends, n = (r.from_in, r.n_in) if inside else (r.from_out, r.n_out)
        found.setdefault(r.file, []).append((r.block, inside, number, ends, number + n))
    return found, heads


_BLOCK = "file string, block long, from_out boolean, from_in boolean, n_out long, n_in long, head string"


def _fields(record: str, mark: str) -> list[str]:
    csv.field_size_limit(1 << 30)
    try:
        return [x.strip() for x in next(csv.reader([record], delimiter=mark, skipinitialspace=True), [])]
    except csv.Error:  # a carriage return amid a field without quotes
        return [x.strip() for x in next(csv.reader([record.replace("\r", " ")], delimiter=mark, skipinitialspace=True), [])]


def read_delimited(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files with a header row, every column as trimmed text, missing cells empty, blank rows left out; adds row_number.

    The delimiter is the one that the first header has most of, the columns are
    those of the first file.  row_number counts a file's records, the header being
    1; empty lines are no records, blank cells are.  Of columns with one name the
    last counts.

    A file is split like any text: tasks read blocks of it, however many lines a
    quoted field has.  Files are read twice, first for where records end.  A
    record that goes on in a further block is put together from its pieces.  A row
    a block reaches the driver.
    """
    begin = spark.read.option("lineSep", "\n").text(path).limit(1).select(F.substring("value", 1, 1 << 20).alias("value"))
    header = begin.select(text.detect_delimiter(F.split_part("value", F.lit("\r"), F.lit(1))).alias("mark"), F.rtrim("value", F.lit("\r")).contains("\r").alias("returns")).first()
    mark, end = (header.mark, "\r" if header.returns else "\n") if header else (",", "\n")
    lines = _lines(spark, path, end)
    blocks, first_records = _blocks(lines, mark, end)
    begins = {(file, b[0]): b for file, each in blocks.items() for b in each}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records of each block, and the pieces of those that lie in several."""
        of = _Quotes(mark)
        block, inside, number, held, out = None, False, 0, [], []

        def done(whole: bool) -> None:
            out.append((block[0], block[1], number, end.join(held), whole))
            held.clear()

        for batch in batches:
            for file, at, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, at) != block:
                    if held:
                        done(False)
                    block = (file, at)
                    _, inside, number, *_ = begins[block]
                    piece = inside
                if not inside and not held and line in ("", "\r"):
                    continue
                held.append(line)
                inside = of.after(line, inside)
                if not inside:
                    done(not piece)
                    piece, number = False, number + 1
            if out:
                yield _record_batch(out)
                out.clear()
        if held:
            done(False)
        if out:
            yield _record_batch(out)

    every = lines.mapInArrow(records, _RECORD)
    whole = every.where("whole").select("file", "number", "record")
    cut = {b[0] for each in blocks.values() for b in each if b[1] or b[3]}
    if cut:
        pieces = lines.where(F.col("block").isin(*cut)).mapInArrow(records, _RECORD).where("not whole")
        together = pieces.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("pieces"))
        whole = whole.union(together.select("file", "number", F.array_join("pieces.record", end).alias("record")))

    if len(first_records) < len(blocks):  # a first record that is longer than a block
        first_records |= {r.file: r.record for r in whole.where("number = 1").collect()}
    heads = {file: _fields(x.removeprefix("\ufeff"), mark) for file, x in first_records.items()}
    first = heads.get(min(blocks), []) if blocks else []
    columns = list(dict.fromkeys(x for x in first if x))
    places = {file: {name: i for i, name in enumerate(head) if name} for file, head in heads.items()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, number, record in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                cells, place = _fields(record, mark), places.get(file, {})
                if any(cells):
                    out.append((*[cells[place[c]] if c in place and place[c] < len(cells) else "" for c in columns], number))
            kinds = [pa.string()] * len(columns) + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=[*columns, "row_number"])

    schema = ", ".join([f"`{c}` string" for c in columns] + ["row_number long"])
    return whole.where("number > 1").mapInArrow(parse, schema)


_RECORD = "file string, block long, number long, record string, whole boolean"


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])


_SPACE = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of a workbook that show dates without being written out in it.
_DATES = {*range(14, 23), *range(45, 48)}


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """The cell styles whose numbers are dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    dates = {int(x.get("numFmtId")) for x in root.iterfind("m:numFmts/m:numFmt", _SPACE) if re.search("[ymdhs]", plain(x.get("formatCode", "")).lower())}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _SPACE)) if int(x.get("numFmtId", 0)) in dates | _DATES}


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part of the workbook's first sheet: as the workbook lists them, else that with the least number."""
    names = sorted((x for x in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.findall(r"\d+", x)[0]))
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets/m:sheet", _SPACE)
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if sheet is not None else []:
            if link.get("Id") == sheet.get(_REL):
                target = link.get("Target", "")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return names[0]


def _iso(serial: str, since_1904: bool) -> str:
    """A date's serial number as ISO text in UTC."""
    start = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
    at = start + dt.timedelta(milliseconds=round(float(serial) * 86_400_000))
    return at.isoformat(timespec="milliseconds") + "Z"


def _cells(content: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet as texts: shown text of rich texts and links, results of formulas, dates in ISO form."""
    tag = f"{{{_SPACE['m']}}}t"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _SPACE):
                shared.append("".join(t.text or "" for t in si.iter(tag)))
        dates = _date_styles(book)
        book_xml = book.read("xl/workbook.xml") if "xl/workbook.xml" in book.namelist() else b""
        since_1904 = re.search(rb'date1904="(1|true)"', book_xml) is not None
        for row in ElementTree.fromstring(book.read(_first_sheet(book))).iterfind(".//m:row", _SPACE):
            out: list[str] = []
            for cell in row.findall("m:c", _SPACE):
                place = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                    place = place * 26 + ord(letter) - 64
                out += [""] * (place - 1 - len(out))
                value, kind = cell.find("m:v", _SPACE), cell.get("t", "n")
                if kind == "inlineStr":
                    out.append("".join(t.text or "" for t in cell.iter(tag)))
                elif value is None or value.text is None:
                    out.append("")
                elif kind == "s":
                    out.append(shared[int(value.text)])
                elif kind == "b":
                    out.append("true" if value.text == "1" else "false")
                elif kind == "n" and int(cell.get("s", -1)) in dates:
                    out.append(_iso(value.text, since_1904))
                else:
                    out.append(value.text)
            yield out


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row_number, values map) of workbooks' first sheets: the first row names the columns, row_number is 2 for the one after it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = _cells(content)
                header = [x.strip() for x in next(rows, [])]
                out = [(name, i, dict(zip(header, (x.strip() for x in [*r, *[""] * (len(header) - len(r))]), strict=False))) for i, r in enumerate(rows, 2) if any(x.strip() for x in r)]
                yield pd.DataFrame(out, columns=["path", "row_number", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row_number long, values map<string,string>")
