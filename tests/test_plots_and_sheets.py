"""Curves of edges, mergeable counts, Student's tail as a column, picks to label, and workbooks."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscreen.operators import counts, network, ranks, views
from loomscreen.sources import tables


def _one_curve(a, b, others, background, centre, spacing, curvature, margin, strength):
    """Direction, score and curvature of one edge, place by place."""
    (x1, y1), (x2, y2) = a, b
    dx, dy = x2 - x1, y2 - y1
    length = math.hypot(dx, dy)
    out = {}
    for side in (1, -1):
        density, nearest = 0.0, math.inf
        for k in range(15):
            t = 0.1 + 0.8 * k / 14
            h = 4 * t * (1 - t) * 2 * curvature * side
            p, w = (x1 + t * dx - dy * h, y1 + t * dy + dx * h), max(0.05, 1 - 2 * (t - 0.5) ** 4)
            for q in others:
                d = math.dist(p, q)
                nearest = min(nearest, d)
                density += max(0.0, 1 - d / (length * 0.3 * margin)) * w
            density += sum(math.dist(p, q) < length * 0.25 * margin for q in background) * strength * w
        outward = ((x1 + dx / 2 - centre[0]) * -dy + (y1 + dy / 2 - centre[1]) * dx) * side
        bonus = min(length / spacing - 1, 3) if length / spacing > 1.5 and (outward > 0 or outward == 0 and side < 0) else 0.0
        out[side] = (density - bonus, nearest, density)
    side = 1 if round(out[1][0], 9) <= round(out[-1][0], 9) else -1
    k, ratio, dense = curvature, length / spacing, out[-1][2]
    if ratio > 1:
        k *= 1 + 1.5 * min(ratio**1.15 - 1, 5)
    if dense > 1:
        close = length * 0.15 * margin
        k *= (1 + min(dense / 10, 2)) * (1 + (close - out[side][1]) / close if out[side][1] < close else 1)
        k = min(k, 15 * curvature)
    return side, out[side][0], k


def test_curves(spark):
    """Edges of very different lengths against every look and point; ends without a place, without length and null places."""
    rng = random.Random(5)
    places = {f"n{k:02}": (rng.gauss(0, 3), rng.gauss(0, 3)) for k in range(24)} | {"n24": (500.0, 80.0), "n25": (1.0, 1.0), "n26": (1.0, 1.0)}
    back = [(rng.gauss(1, 2), rng.gauss(-1, 2)) for _ in range(300)]
    names = sorted(places)
    edges = [(a, b, rng.random()) for a in names for b in names if a < b and rng.random() < 0.2] + [("n25", "n26", 1.0), ("n00", "gone", 1.0), ("n00", "null", 2.0)]
    nodes = spark.createDataFrame([(k, *v) for k, v in places.items()] + [("null", None, 1.0)], "node string, x double, y double")
    background = spark.createDataFrame([*back, (None, 2.0)], "x double, y double")
    df = spark.createDataFrame(edges, "i string, j string, v double")
    spacing = float(np.median([math.dist(places[a], places[b]) for a, b in zip(names, names[1:], strict=False)]))
    centre = tuple(np.mean(list(places.values()), axis=0))
    for points, margin in ((background, 1.0), (None, 1.7)):
        got = {(r.i, r.j): r for r in network.curves(df, nodes, points, 0.05, margin, 0.3).collect()}
        assert set(got) == {(a, b) for a, b, _ in edges[:-2]}
        flat = got.pop(("n25", "n26"))
        assert (flat.direction, flat.curvature, flat.score, flat.cx) == (1, 0.05, None, 1.0)
        for (a, b), r in got.items():
            side, score, k = _one_curve(places[a], places[b], [q for n, q in places.items() if n not in (a, b)], back if points is not None else [], centre, spacing, 0.05, margin, 0.3)
            assert r.direction == side and r.score == pytest.approx(score, abs=1e-8) and r.curvature == pytest.approx(k), (a, b)
            dx, dy = places[b][0] - places[a][0], places[b][1] - places[a][1]
            assert (r.cx, r.cy) == pytest.approx((places[a][0] + dx / 2 - dy * k * side, places[a][1] + dy / 2 + dx * k * side))
    assert network.curves(df.limit(0), nodes).collect() == []


def test_merged_sketches(spark):
    """Stored sketches of days merge to what one sketch of all rows counts, with overlaps counted once, within the stated error."""
    rows = spark.range(60_000).select((F.col("id") % 3).alias("sample"), (F.col("id") % 7).alias("day"), F.xxhash64(F.col("id") % 40_000).alias("umi"))
    df = rows.unionByName(spark.createDataFrame([(None, 1, 5), (9, 1, None)], "sample long, day long, umi long"))
    days = counts.sketches(df, ["sample", "day"], "umi")
    got = {r["sample"]: r["n"] for r in counts.merged(days, ["sample"]).collect()}
    assert set(got) == {0, 1, 2, 9} and got[9] == 0
    for k in range(3):
        exact = len({i % 40_000 for i in range(k, 60_000, 3)})
        assert abs(got[k] - exact) <= 4 * 1.04 / 64 * exact
    everything = counts.merged(days.where("sample < 3").withColumn("all", F.lit(1)), ["all"]).first()["n"]
    assert abs(everything - 40_000) <= 4 * 1.04 / 64 * 40_000
    assert counts.merged(counts.sketches(df.limit(0), ["sample"], "umi"), ["sample"]).collect() == []


def test_t_tail_column(spark):
    """Two-sided tails by adding up the density, deep tails by their leading term, and missing values."""
    for t, df in ((0.3, 4), (2.5, 9), (7.0, 30), (1.0, 600)):
        x = np.linspace(0, t, 200_001)
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
        assert ranks.log10_t_tail(t, df) == pytest.approx(math.log10(1 - 2 * np.trapezoid(density, x)), abs=1e-3 if t == 7 else 1e-7)
    rows = [(0.0, 5.0), (60.0, 5000.0), (2.0, 0.0), (None, 3.0), (3.0, None), (-2.5, 9.0)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, df double").coalesce(1).select(ranks.log10_t_tail_udf("t", "df").alias("p")).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] < -500 and got[2:5] == [None] * 3 and got[5] == pytest.approx(ranks.log10_t_tail(2.5, 9))
    bound = spark.createDataFrame([(-3.2,), (-0.5,), (-900.0,)], "p double").coalesce(1).select(ranks.p_bound(F.col("p")).alias("b")).collect()
    assert [r.b for r in bound] == [-3, 0, -307]


def test_annotated(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 1.0, 5.0), ("c", 1.0, 9.0), ("d", -1.0, 7.0), ("e", 1.0, None)], "g string, x double, w double")
    got = views.annotated(df, {"up": (F.col("x") > 0, "w"), "down": (F.col("x") < 0, "w")}, 2).collect()
    assert sorted((r.pick, r.g) for r in got) == [("down", "d"), ("up", "a"), ("up", "c")]


def _workbook(rows, shared, name="Data"):
    out = io.BytesIO()
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Empty" sheetId="1" r:id="rId1"/><sheet name="{name}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {space}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>{shared}</sst>")
    return out.getvalue()


def test_spreadsheet(spark, tmp_path):
    """Shared, inline and rich texts, skipped rows, gaps, errors and truth values; several workbooks; a column that isn't there."""
    shared = "<si><t>gene</t></si><si><t>score</t></si><si><r><t>AB</t></r><r><t>C</t></r><rPh><t>x</t></rPh></si><si><t>hits</t></si>"
    rows = (
        '<row r="1"><c r="A1" t="inlineStr"><is><t>A title</t></is></c></row>'
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>3</v></c><c r="E3" t="str"><v>ok</v></c></row>'
        '<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4"><v>1.5E-3</v></c><c r="D4"><v>7</v></c><c r="E4" t="b"><v>1</v></c></row>'
        '<row r="6"><c r="A6" t="inlineStr"><is><t>x&amp;y</t></is></c><c r="B6" t="e"><v>#N/A</v></c></row><row r="7"/>'
    )
    for name in ("a", "b"):
        (tmp_path / f"{name}.xlsx").write_bytes(_workbook(rows, shared))
    schema = "gene string, hits int, score double, ok boolean"
    want = [("ABC", 7, 0.0015, True), ("x&y", None, None, None)]
    for sheet, skip in (("Data", 1), (1, [0]), (1, 2)):
        got = tables.read_spreadsheet(spark, f"{tmp_path}/a.xlsx", schema, sheet, skip)
        assert got.dtypes == [("gene", "string"), ("hits", "int"), ("score", "double"), ("ok", "boolean")]
        assert sorted(map(tuple, got.collect())) == want
    assert tables.read_spreadsheet(spark, f"{tmp_path}/*.xlsx", schema, "Data", 1).count() == 4
    assert tables.read_spreadsheet(spark, f"{tmp_path}/a.xlsx", schema, "Empty").count() == 0
    with pytest.raises(Exception, match="no columns"):
        tables.read_spreadsheet(spark, f"{tmp_path}/a.xlsx", "other int", "Data", 1).collect()
    with pytest.raises(Exception, match="no sheet"):
        tables.read_spreadsheet(spark, f"{tmp_path}/a.xlsx", schema, "Data2").collect()


def test_nearest_on_a_line(spark):
    """Equal to comparing all: ties, equal centres, places of many points, missing values, no centres."""
    from loomscreen.operators import running

    rng = random.Random(2)
    points = [(k, float(rng.randint(0, 60)) / 2) for k in range(400)] + [(500 + k, 7.0) for k in range(300)] + [(900, None), (901, -50.0), (902, 99.0)]
    centres = [(k, float(rng.randint(0, 30))) for k in range(12)] + [(20, 5.0), (21, 5.0), (None, 3.5), (30, None)]
    p, c = spark.createDataFrame(points, "q long, x double"), spark.createDataFrame(centres, "k long, c double")
    got = {r.q: r.k for r in running.nearest(p, c, "x", "c", "k").collect()}
    known = [(k, v) for k, v in centres if k is not None and v is not None]
    assert got == {q: None if x is None else min((abs(x - v), k) for k, v in known)[1] for q, x in points}
    none = running.nearest(p, c.limit(0), "x", "c", "k").collect()
    assert len(none) == len(points) and {r.k for r in none} == {None}


def test_axis_order(spark):
    """Items by a plain single linkage: at each merge the part of the lesser distance first."""
    rng = random.Random(8)
    cells = [(f"t{i:02}", f"g{j}", round(rng.random() * 9, 3)) for i in range(14) for j in range(6) if rng.random() < 0.6]
    names = sorted({a for a, _, _ in cells})
    rows = {n: [next((v for a, b, v in cells if (a, b) == (n, f"g{j}")), 0.0) for j in range(6)] for n in names}
    groups = [(0.0, [n]) for n in names]
    while len(groups) > 1:
        d, a, b = min((min(math.dist(rows[p], rows[q]) for p in groups[a][1] for q in groups[b][1]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        # Groups stand in the order in which they were formed.
        new = (d, groups[a][1] + groups[b][1])
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [new]
    df = spark.createDataFrame([*cells, (None, "g1", 1.0), ("t00", None, 1.0)], "term string, gene string, v double")
    got = views.axis_order(df, "term", "gene", "v").orderBy("position").collect()
    assert [r.label for r in got] == groups[0][1] and [r.position for r in got] == list(range(len(names)))
