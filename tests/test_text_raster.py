"""Text in three scripts, and rasters checked against plain arrays."""

import numpy as np
from pyspark.sql import functions as F

from stormledger.functions import labels as L
from stormledger.functions import text as X
from stormledger.operators import raster as RA


def val(spark, col):
    return spark.range(1).select(col).first()[0]


def words(spark, text, lang):
    return val(spark, X.number_words(F.lit(text), F.lit(lang)))


def test_number_words_respect_script_boundaries(spark):
    assert words(spark, "Two hospitals, no stone {{two}} TEN", "en") == ["two", "ten"]
    assert words(spark, "তিনি তিন দিন দুইটি নয়", "bn") == ["তিন", "দুইটি"]
    assert words(spark, "दोनों दोष छः", "hi") == ["दोनों", "छः"]
    assert val(spark, X.digits(F.lit("৩ km, {{x_1}} 4"))) == ["৩", "4"]


def test_repair(spark):
    keys = F.create_map(F.lit(2), F.lit("isolated_count"), F.lit(10), F.lit("standin_count"))
    fix = lambda t, lang: val(spark, X.repair_counts(F.lit(t), lang, keys))
    assert fix("Two wards, both wind and surge; both shut. Three {{a}}.", "en") == "{{isolated_count}} wards, both wind and surge; {{isolated_count}} shut. Three {{a}}."
    assert fix("দুইটি হাসপাতাল দশজন", "bn") == "{{isolated_count}}টি হাসপাতাল {{standin_count}}জন"
    assert fix("दोनों अस्पताल", "hi") == "{{isolated_count}} अस्पताल"


def test_fill_capitalises_and_drops_repeated_units(spark):
    shown = F.create_map(F.lit("t"), X.format_number(F.lit(20.0), F.lit("min"), "en"), F.lit("d"), F.lit("storm surge"), F.lit("w"), X.format_number(F.lit(33.0), F.lit("m/s"), "en"))
    units = F.create_map(F.lit("t"), F.lit("min"), F.lit("w"), F.lit("m/s"))
    out = val(spark, X.fill(F.lit("{{d}} comes. {{ d }}: {{t}} minutes, {{w}} km/h. Of {{d}}{{t}}"), shown, units))
    assert out == "Storm surge comes. Storm surge: 20 min, 120 km/h. Of storm surge20 min"
    assert val(spark, X.format_number(F.lit(1.0), F.lit("h"), "en")) == "1 hour"
    assert val(spark, X.format_number(F.lit(12.5), F.lit("km"), "bn")) == "১২.5 কিমি".replace("5", "৫")


def test_duplicate_counts_and_keys(spark):
    values = F.create_map(F.lit("a_count"), F.lit(2), F.lit("b_count"), F.lit(2), F.lit("c_count"), F.lit(3))
    one = lambda s: val(spark, X.duplicate_counts(F.lit(s), values))
    assert one("{{a_count}} of {{b_count}} and {{c_count}}") == ["a_count=b_count"] and one("{{a_count}} {{a_count}}") == []
    assert val(spark, X.sentences(F.lit("One. Two! तीन। End"))) == ["One.", "Two!", "तीन।", "End"]
    assert val(spark, X.removed_keys(F.lit("{{ a }}"), F.array(F.lit("a"), F.lit("b")))) == ["b"]


def reference_split(text, limit):
    """Straightforward statement of the rule, for comparison."""
    parts, cur = [], ""
    for line in text.split("\n"):
        if len(line) > limit:
            if cur:
                parts.append(cur)
            n = (len(line) - 1) // limit
            parts += [line[i * limit : (i + 1) * limit] for i in range(n)]
            line, cur = line[n * limit :], ""
        if cur and len(cur) + 1 + len(line) > limit:
            parts.append(cur)
            cur = line
        else:
            cur = cur + "\n" + line if cur else line
    return parts + ([cur] if cur else [])


def test_split_message(spark):
    for text in ["a\nbb\nccc", "x" * 25, "ab\n" + "y" * 23 + "\nz", "\n\nq", "x" * 10 + "\n" + "y" * 10, "x" * 20]:
        got = val(spark, X.split_message(F.lit(text), 10))
        assert got == reference_split(text, 10) and all(len(p) <= 10 for p in got)


def test_masks_actions_and_approvers(spark):
    assert val(spark, F.array(X.mask_email(F.lit("anna@x.org")), X.mask_email(F.lit("ab@x.org")), X.mask_id(F.lit("123456")), X.mask_id(F.lit("1234")))) == ["an***@x.org", "a***@x.org", "***3456", "****"]
    full = F.array(*[F.lit(str(i)) for i in range(5)])
    assert val(spark, F.size(X.add_action(F.slice(full, 1, 3), F.lit(0), F.lit("Find a safe building.")))) == 4
    assert val(spark, X.too_many_actions(full, F.lit(0), F.lit("Find a safe building."))) is True
    assert val(spark, F.array(*[X.approver_ok(F.lit(t)) for t in ("A B (BDO)", "A (Other: x)", "A (Clerk)", "(BDO)")])) == [True, True, False, False]


def test_name_keys_and_classes(spark):
    composed, split = "Café-Hospital", "Café-Hospital"
    d = spark.createDataFrame([(composed,), (split,)], "t string").select(X.name_key(X.nfc(F.col("t"))).alias("k"))
    assert [r.k for r in d.collect()] == ["café hospital"] * 2
    tags = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(v))])
    kind = lambda **kw: val(spark, L.shelter_kind(tags(**kw)))
    assert kind(amenity="school", name="Flood Shelter") == "cyclone_shelter" and kind(building="public", name="Beat Office") is None
    assert kind(office="government") == "public_building_proxy" and kind(name="ঘূর্ণিঝড় আশ্রয়", amenity="x") == "cyclone_shelter"
    assert val(spark, L.facility_level(tags(amenity="clinic", name="Kulpi Rural Hospital"))) == "hospital"


def raster(spark, a, scene="s"):
    rows = [(scene, i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "scene string, row long, col long, db double")


def test_focal_filters_equal_padded_arrays(spark):
    a = np.random.default_rng(1).normal(-12, 3, (23, 17))
    p = 10 ** (a / 10)
    pad = np.pad(p, 3, mode="reflect")
    win = np.lib.stride_tricks.sliding_window_view(pad, (7, 7))
    want = {"median": np.median(win, axis=(2, 3)), "boxcar": win.mean(axis=(2, 3))}
    for method, w in want.items():
        got = np.zeros_like(a)
        for r in RA.focal(raster(spark, a), ["scene"], method, 7, 8).collect():
            got[r.row, r.col] = r.db
        assert np.allclose(got, 10 * np.log10(w))


def test_mask_and_opening(spark):
    before, after = np.full((7, 7), -10.0), np.full((7, 7), -10.0)
    after[1:5, 1:5] = -18.0
    after[6, 6] = -18.0
    water = raster(spark, np.zeros((7, 7))).withColumnRenamed("db", "occurrence")
    mask = RA.change_mask(raster(spark, before), raster(spark, after), water, ["scene"])
    assert mask.filter("flooded").count() == 17
    assert {(r.row, r.col) for r in RA.opening(mask, ["scene"]).collect()} == {(i, j) for i in range(1, 5) for j in range(1, 5)}
    wet = water.withColumn("occurrence", F.lit(20.0))
    assert RA.change_mask(raster(spark, before), raster(spark, after), wet, ["scene"]).filter("flooded").count() == 0
    edge = spark.createDataFrame([("s", 0, 0, -30.0), ("s", 0, 1, -30.01)], "scene string, row long, col long, db double")
    assert [r.db for r in RA.mask_noise(edge).orderBy("col").collect()] == [-30.0, None]


def test_small_clusters_and_isolines(spark):
    px = spark.createDataFrame([("s", 0, 0), ("s", 1, 1), ("s", 2, 2), ("s", 5, 5)], "scene string, row long, col long")
    assert {(r.row, r.col) for r in RA.drop_small(px, "scene", 2).collect()} == {(0, 0), (1, 1), (2, 2)}
    grid = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 2.0)], "r long, c long, v double")
    got = RA.isolines(grid, [], "v", [1.0]).collect()
    assert len(got) == 1 and {(got[0].x0, got[0].y0), (got[0].x1, got[0].y1)} == {(0.5, 0.0), (0.5, 1.0)}


def test_the_flood_chain_is_run_once(spark, monkeypatch):
    from conftest import SF
    from stormledger.operators import network
    from stormledger.plans import load_all
    from stormledger.plans.registry import QUERIES

    load_all()
    met, shown = [], network.components
    monkeypatch.setattr(network, "components", lambda links, scenario=None: met.append(links) or shown(links, scenario))
    QUERIES["flood_pipeline"](spark, SF)
    (sides,) = met
    assert sides.inputFiles() and all("/flooded-" in f for f in sides.inputFiles())


def test_figures_are_written_by_their_exact_values(spark):
    import random

    from stormledger.functions.numeric import fixed_text

    r = random.Random(5)
    values = [0.51345, 0.53755, 0.03125, 0.09375, -0.51345, -0.00001, 0.0, 1.0, 0.99995, 5e-324, 0.00005, 123456789.00005, 2.0**39 - 2.0**-14]
    values += [r.randrange(-10**6, 10**6) / 10**5 for _ in range(2000)] + [r.uniform(-1, 1) * 10 ** r.randint(-6, 15) for _ in range(4000)]
    values += [k / 32 for k in range(64)] + [r.randrange(2**40) / 2 ** r.randint(1, 20) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 4, 8):
        for x, text in df.select("x", fixed_text(F.col("x"), digits)).collect():
            if abs(x) < 2.0**53 / 10**digits:
                assert text == f"{x:.{digits}f}", (x, digits)
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),), (1e300,)], "x double")
    assert [r[0] for r in odd.select(fixed_text(F.col("x"), 4)).collect()][:3] == [None, "Infinity", "NaN"]


def test_report_means_that_lie_on_a_tie(spark):
    from stormledger.operators import validation as V

    rows = [("de", 0.5136, 0.5487), ("en", 0.4824, 0.5259), ("es", 0.4387, 0.4775), ("fr", 0.4566, 0.5017)]
    lines = V.report(spark.createDataFrame(rows, "zone_id string, iou double, accuracy double"), "zone_id", ["iou", "accuracy"], "t").collect()
    assert [tuple(r) for r in lines][2:] == [
        (2, "", "|---|---|---|"), *[(3, z, f"| {z} | {i:.4f} | {a:.4f} |") for z, i, a in rows], (4, "", "| mean | 0.4728 | 0.5134 |"),
    ]
    empty = V.report(spark.createDataFrame([], "zone_id string, iou double, accuracy double"), "zone_id", ["iou", "accuracy"], "t").collect()
    assert [r.line for r in empty] == ["# t", "| zone | iou | accuracy |", "|---|---|---|", None]
