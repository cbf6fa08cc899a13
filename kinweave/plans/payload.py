"""Results as JSON. The shapes of charts are put together on the driver, from aggregated frames of a few rows, the last step of a
query; rows, however many, are encoded on the executors (`json_rows`) and written from there (`write_json`)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from kinweave.operators import rank


def encode(payload: object) -> str:
    """Compact JSON; what isn't UTF-8 becomes U+FFFD."""
    return json.dumps(payload, ensure_ascii=False, separators=(",", ":")).encode(errors="replace").decode()


def _clean(value: Column, kind: DataType) -> Column:
    """What JSON can hold: malformed UTF-8 becomes U+FFFD, and a number that isn't finite is an error."""
    if isinstance(kind, StringType):
        return F.make_valid_utf8(value)
    if isinstance(kind, (FloatType, DoubleType)):
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(odd, F.raise_error(F.lit("a number that isn't finite has no JSON form")).cast(kind)).otherwise(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(F.transform_keys(value, lambda k, _: _clean(k, kind.keyType)), lambda _, v: _clean(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(_clean(value[f.name], f.dataType).alias(f.name) for f in kind)))
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """json: every row as one compact object, its columns in their order, nulls kept; made where the row is."""
    columns = [_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def attribute(json_text: Column) -> Column:
    """JSON for a place within quotes of markup. The five signs and their entities, the ampersand first."""
    for sign, entity in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#039;"), ("<", "&lt;"), (">", "&gt;")):
        json_text = F.replace(json_text, F.lit(sign), F.lit(entity))
    return json_text


def write_json(df: DataFrame, path: str) -> None:
    """A folder of files with one object a line, each written by the task that holds its rows; nothing goes through the driver."""
    json_rows(df).write.mode("overwrite").text(path)


def wire_frame(df: DataFrame, url: str = "{xref}") -> DataFrame:
    """Individual rows (see Tree.wire_rows) with the page of each, for `json_rows` and `write_json`."""
    before, _, after = url.partition("{xref}")
    return df.select("xref", "label", "sex", "birth", "death", F.concat(F.lit(before), "xref", F.lit(after)).alias("url"))


def rows_of(df: DataFrame, *order: str) -> list:
    return (df.orderBy(*order) if order else df).collect()


def line_chart(df: DataFrame, category: str, series: dict[str, str]) -> dict:
    """series: name to column; null values stay null."""
    rows = rows_of(df, category)
    return {"categories": [str(r[category]) for r in rows], "series": [{"name": n, "values": [r[c] for r in rows], "tooltips": [], "tooltipLabels": []} for n, c in series.items()]}


def stacked_bar(df: DataFrame, category: str, series: dict[str, str]) -> dict:
    rows = rows_of(df, category)
    return {"categories": [str(r[category]) for r in rows], "tooltipLabels": [str(r[category]) for r in rows], "series": [{"name": n, "data": [r[c] for r in rows], "class": c} for n, c in series.items()]}


def heatmap(df: DataFrame, row: str, col: str, value: str) -> dict:
    rows = rows_of(df, row, col)
    ys, xs = sorted({r[row] for r in rows}), sorted({r[col] for r in rows})
    at = {(r[row], r[col]): r[value] for r in rows}
    return {"rows": [str(y) for y in ys], "cols": [str(x) for x in xs], "colTitles": [str(x) for x in xs], "values": [[at.get((y, x), 0) for x in xs] for y in ys]}


def chord(df: DataFrame) -> dict:
    """row_label, col_label, n of a pair matrix; labels in byte order."""
    rows = rows_of(df)
    labels = sorted({r.row_label for r in rows})
    at = {(r.row_label, r.col_label): r.n for r in rows}
    return {"labels": labels, "matrix": [[at.get((a, b), 0) for b in labels] for a in labels]}


def pyramid(df: DataFrame, group: str, band: str) -> dict:
    rows = rows_of(df, group, band)
    groups, bands = sorted({r[group] for r in rows}), sorted({r[band] for r in rows}, reverse=True)
    at = {(r[group], r[band]): {"left": r.left_n, "right": r.right_n} for r in rows}
    return {"groups": [str(g) for g in groups], "bands": [str(b) for b in bands], "data": [[at.get((g, b), {"left": 0, "right": 0}) for b in bands] for g in groups]}


def sankey(df: DataFrame) -> dict:
    """Flows as nodes and links; samples are xrefs."""
    rows = rows_of(df, "ord")
    names = {r.source_node: r.source for r in rows} | {r.target_node: r.target for r in rows}
    return {"nodes": [{"name": names[k]} for k in sorted(names)], "links": [{"source": r.source_node, "target": r.target_node, "value": r.weight, "samples": [{"xref": x} for x in r.samples.split(",") if x]} for r in rows]}


def mapped(df: DataFrame, order: Column, label: Column, value: Column, tooltip: Column | None = None, css: Column | None = None) -> DataFrame:
    """ord, label, value, tooltip, class of the rows of a chart, decorated where they are and numbered in their order."""
    empty = F.lit("")
    rows = df.select(order.alias("at"), label.alias("label"), value.alias("value"), (empty if tooltip is None else tooltip).alias("tooltip"), (empty if css is None else css).alias("class"))
    return rank.numbered(rows, F.col("at"), F.col("label")).select("ord", "label", "value", "tooltip", "class")


def wire(df: DataFrame, url: str = "{xref}") -> list[dict]:
    """Individual rows (see Tree.wire_rows) of a ranked or limited frame, with the page of each."""
    return [{"xref": r.xref, "label": r.label, "sex": r.sex, "birth": r.birth, "death": r.death, "url": url.format(xref=r.xref)} for r in rows_of(df, "xref")]


def ranking(df: DataFrame, xref: str, label: str, value: str) -> list[dict]:
    return [{"xref": r[xref], "label": r[label], "value": r[value]} for r in rows_of(df, "ord")]


def progress(df: DataFrame, label: str, value: str) -> list[dict]:
    """Two-digit ranks and percentages of the largest; nothing if there is no positive value."""
    rows = rows_of(df, "ord")
    top = max((r[value] for r in rows), default=0)
    return [{"rank": f"{k:02d}", "label": r[label], "value": r[value], "percent": 100 * r[value] / top} for k, r in enumerate(rows, 1)] if top > 0 else []
