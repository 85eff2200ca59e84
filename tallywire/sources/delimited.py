"""Delimited text whose delimiter is found in its first line."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CANDIDATES = (",", "\t", "|", ";")


def sniff(text: str) -> str:
    """The candidate that the first line with anything on it has most of; of equals the last one."""
    line = next((x for x in text.split("\n") if x.strip()), "")
    best = CANDIDATES[0]
    for c in CANDIDATES:
        if line.count(c) >= line.count(best):
            best = c
    return best


def cells(line: str, sep: str) -> list[str]:
    """Trimmed cells of a line; a quote inside quotes is written twice; a cell never goes beyond its line."""
    out, now, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                now.append(c)
                i += 1
            elif c == '"':
                quoted = False
            else:
                now.append(c)
        elif c == '"':
            quoted = True
        elif c == sep:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        i += 1
    return [*out, "".join(now).strip()]


def parse(text: str, sep: str | None = None) -> tuple[list[str], list[list[str]]]:
    """Header and rows. Blank lines are skipped, short rows filled up with empty cells, long rows kept long."""
    sep = sep or sniff(text)
    lines = [cells(x.rstrip("\r"), sep) for x in text.split("\n") if x.strip()]
    if not lines:
        raise ValueError("no content")
    head = lines[0]
    return head, [r + [""] * (len(head) - len(r)) for r in lines[1:]]


def records(text: str) -> Iterator[dict[str, str]]:
    head, rows = parse(text)
    for r in rows:
        yield dict(zip(head, r, strict=False))


def field(record: dict[str, str], name: str) -> str | None:
    """The first field of that name in any case."""
    return next((v for k, v in record.items() if k.lower() == name.lower()), None)


def parsed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_no, fields map) of the delimited text in each row; a blank or null one has no rows."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        fields = pa.map_(pa.string(), pa.string())
        for b in batches:
            rows = [(p, i, list(r.items())) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and t.strip() for i, r in enumerate(records(t))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], fields)], [id_col, "row_no", "fields"])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, row_no bigint, fields map<string,string>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, fields map) of all files below a path; a file that has nothing in it has no rows."""
    return parsed(spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS path", "value"), "path", "value")
