import json
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.classify import Rules
from shelfmark.operators import merge, relocate, reports, sources
from shelfmark.plans import views
from shelfmark.plans.catalog import Catalog
from shelfmark.plans.files import Snapshots, atomic_write, load_sources, save_sources
from shelfmark.schema import ITEM, STATUS
from shelfmark.sources import archives, tree

RULES = Rules(factions=[("Orks", r"\bork\b")], types=[("titan", "titan")], war_category="War", default_category="Other")


def stl(path, triangles):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\0" * (84 + 50 * triangles))


@pytest.fixture
def library(tmp_path, spark):
    models = tmp_path / "models"
    for k, name in enumerate(("body", "leg_left", "leg_right")):
        stl(models / "Warhound Titan/files" / f"{name}.stl", 2 + k)
    stl(models / "Ork Nob/nob.stl", 2)
    catalog = Catalog(spark, tmp_path / "catalog", RULES)
    return models, catalog


def by_name(catalog):
    return {os.path.basename(r["path"]): r for r in catalog.items().collect()}


def test_scan_and_rescan(library):
    models, catalog = library
    assert catalog.scan([str(models)]) == {"items": 2, "added": 2, "unreadable": 0}
    first = by_name(catalog)
    titan = first["files"]
    assert (titan["size_bytes"], titan["primary_file"], titan["part_count"], titan["thumb_status"]) == (702, "leg_right.stl", 3, "pending")
    assert first["Ork Nob"]["faction"] == "Orks" and first["Ork Nob"]["tags"] == ["faction:Orks", "format:stl", "source:models", "packed:false"]
    assert catalog.scan() == {"items": 2, "added": 0, "unreadable": 0}
    assert {k: (v["id"], v["path"], v["ord"]) for k, v in by_name(catalog).items()} == {k: (v["id"], v["path"], v["ord"]) for k, v in first.items()}
    assert all(r["thumb_status"] in STATUS for r in by_name(catalog).values())


def test_junk_and_names_that_other_readers_lose(library, spark, tmp_path):
    models, catalog = library
    for name in ("Some Kit/__MACOSX/._body.stl", "Another Kit/._sneaky.stl", "Another Kit/real.stl", "_under/_u.stl", ".hid/h.stl", "p/100%.stl", "p/y z.STL"):
        stl(models / name, 1)
    (models / "Another Kit/big.gcode").write_text("x")
    os.symlink(models / "Ork Nob", models / "linked")
    os.symlink(models / "gone.stl", models / "p/dangling.stl")
    got = {(os.path.relpath(r["dir"], models), r["name"], r["size"]) for r in tree.scan(spark, [str(models)]).collect()}
    assert {("Another Kit", "real.stl", 134), ("_under", "_u.stl", 134), (".hid", "h.stl", 134), ("p", "100%.stl", 134), ("p", "y z.STL", 134), ("p", "dangling.stl", 0)} <= got
    assert not any(n.startswith("._") or d == "linked" or "MACOSX" in d or n.endswith("gcode") for d, n, _ in got)
    catalog.scan([str(models)])
    assert by_name(catalog)["Another Kit"]["model_files"] == ["real.stl"] and by_name(catalog)["p"]["formats"] == ["STL", "stl"]
    assert tree.scan(spark, [str(tmp_path / "nowhere")]).where("unreadable").count() == 1


def test_archives(library, spark):
    models, catalog = library
    with zipfile.ZipFile(models / "Bits.zip", "w") as z:
        for name, size in (("a.stl", 284), ("in/b.STL", 384), ("c.obj", 9), ("notes.txt", 3), ("__MACOSX/._a.stl", 4), ("._s.stl", 1)):
            z.writestr(name, b"0" * size)
    (models / "Broken.zip").write_text("no")
    (models / "Old.rar").write_text("Rar!")
    catalog.scan([str(models)])
    assert by_name(catalog)["Bits.zip"]["thumb_status"] == "packed"
    catalog.look_inside()
    got = by_name(catalog)
    bits = got["Bits.zip"]
    assert (bits["part_count"], bits["inner_bytes"], bits["model_files"], bits["formats"]) == (3, 677, ["b.STL", "a.stl", "c.obj"], ["obj", "stl", "zip"])
    assert got["Broken.zip"]["thumb_status"] == "packed" and "not a readable zip" in got["Broken.zip"]["thumb_error"]
    assert got["Old.rar"]["thumb_status"] == "unsupported" and ".rar" in got["Old.rar"]["thumb_error"]
    catalog.scan()
    assert by_name(catalog)["Bits.zip"]["part_count"] == 3
    with zipfile.ZipFile(models / "Bits.zip") as z:
        assert archives.bounded(z.open("a.stl"), 283) is None and len(archives.bounded(z.open("a.stl"), 284)) == 284


def test_move_prune_and_offline_roots(library, spark):
    models, catalog = library
    catalog.scan([str(models)])
    old = by_name(catalog)["files"]
    thumbs = catalog.folder / "thumbnails"
    thumbs.mkdir()
    (thumbs / f"{old['id']}.webp").write_bytes(b"w")
    catalog.mark_thumbnails()
    (models / "Re").mkdir()
    shutil.move(models / "Warhound Titan", models / "Re/Warhound Titan")
    catalog.scan()
    assert catalog.items().count() == 3
    assert catalog.relocate() == {"moved": 1, "deduped": 0, "dropped": 0, "kept_unreachable": 0}
    new = by_name(catalog)["files"]
    assert new["path"].endswith("Re/Warhound Titan/files") and new["thumbnail"] == f"{new['id']}.webp" and (thumbs / new["thumbnail"]).exists()
    catalog.scan()
    assert catalog.items().count() == 2 and by_name(catalog)["files"]["thumb_status"] == "existing"
    shutil.rmtree(models / "Ork Nob")
    assert catalog.relocate(prune=True)["dropped"] == 1
    shutil.move(models, models.with_name("away"))
    out = catalog.relocate(prune=True)
    assert out["dropped"] == 0 and out["kept_unreachable"] == 1 and catalog.items().count() == 1


def test_several_missing_one_present(spark):
    rows = [("a", "f", False, 1), ("b", "f", False, 2), ("c", "f", True, 0), ("d", "g", False, 3), ("e", "g", True, 4), ("h", "g", True, 5), ("i", None, False, 6)]
    got = sorted(map(tuple, relocate.moves(spark.createDataFrame(rows, "id string, fp string, present boolean, ord long")).collect()))
    assert got == [("f", "a", 1, "c", False), ("f", "b", 2, "c", True)]


def test_upsert_overwrites_with_nulls(spark):
    old = spark.createDataFrame([("1", "x", "keep", 0), ("2", "y", "keep", 1)], "id string, v string, extra string, ord long")
    new = spark.createDataFrame([("1", None, 9), ("3", "z", 5)], "id string, v string, ord long")
    assert sorted(map(tuple, merge.upsert(old, new, ["v"]).collect())) == [("1", None, "keep", 0), ("2", "y", "keep", 1), ("3", "z", None, 5)]


def test_same_path_rows(spark):
    from itertools import product

    from shelfmark.functions.scalars import stable_id

    path = "c:\\kit"
    canon = spark.range(1).select(stable_id(F.lit(path))).first()[0]

    def fold(rows):
        keep = None
        for i, t in sorted(rows):
            if keep is None:
                keep = [i, t]
                continue
            if i == canon and keep[0] != canon:
                keep, drop = [i, t], keep
            elif keep[0] == canon:
                drop = [i, t]
            elif keep[1] and not t:
                drop = [i, t]
            else:
                keep, drop = [i, t], keep
            keep[1] = keep[1] or drop[1]
        return keep[0], keep[1]

    data, want = [], {}
    for case, (ids, flags) in enumerate((i, f) for n in (2, 3) for i in ({2: [("0", "1"), ("0", canon), (canon, "zz")], 3: [("0", "1", "2"), ("0", canon, "zz"), (canon, "y", "zz")]}[n]) for f in product((0, 1), repeat=n)):
        rows = list(zip(ids, flags))
        want[case] = fold(rows)
        data.append((case, rows))
    for case, rows in data[::3]:
        df = spark.createDataFrame([(i, "project", path + "\\", "t" if f else None, "mesh") for i, f in rows] + [("q", "archive", path, None, "packed")], "id string, type string, path string, thumbnail string, thumb_status string")
        df = df.withColumn("path", F.lit(path))
        got = [r for r in merge.dedupe_paths(df).collect() if r["type"] == "project"]
        assert [(r["id"], int(r["thumbnail"] is not None)) for r in got] == [want[case]], rows


def test_longest_prefix_respects_separators(spark):
    roots = spark.createDataFrame([("c:/m", 0), ("C:\\m\\deep", 1), ("c:/m/", 2), ("d:", 3)], "root string, ord int")
    paths = spark.createDataFrame([(p,) for p in ("c:\\mm\\x", "c:\\M\\x", "c:/m/deep/y", "c:\\m", "e:\\q", None)], "path string")
    got = {r["path"]: r["root"] for r in sources.longest_root(paths, roots).collect()}
    assert got == {"c:\\mm\\x": None, "c:\\M\\x": "c:/m", "c:/m/deep/y": "C:\\m\\deep", "c:\\m": "c:/m", "e:\\q": None, None: None}


def test_reclassify(library):
    models, catalog = library
    catalog.scan([str(models)])
    before = catalog.snapshots.current()
    assert catalog.reclassify(dry_run=True).count() == 0 and catalog.reclassify().count() == 0
    assert catalog.snapshots.current() == before
    catalog.rules = Rules(categories=[("Titans", "titan")], default_category="Other")
    assert catalog.reclassify(dry_run=True).count() == 2 and catalog.snapshots.current() == before
    assert reports.change_counts(reports.reclassified(catalog.items(), catalog.rules, catalog.roots())).first()["faction"] == 1
    catalog.reclassify()
    got = by_name(catalog)
    assert got["files"]["category"] == "Titans" and got["Ork Nob"]["faction"] is None
    assert [r["name"] for r in catalog.unmatched().collect()] == ["Ork Nob"] and "path" not in catalog.unmatched().columns


def test_duplicates_and_views(library):
    models, catalog = library
    for k in range(3):
        stl(models / f"Copy {k}/body.stl", 3)
        stl(models / f"Copy {k}/arm.stl", 4)
    stl(models / "Bust/head.stl", 2)
    stl(models / "Bust hires/head.stl", 40)
    stl(models / 'Bits <b>"and"</b> & bobs/x.stl', 1)
    catalog.scan([str(models)])
    exact, near = catalog.duplicates()
    assert [(r["grp"], r["copies"], r["waste"]) for r in exact.collect()] == [("exact-1", 3, 2 * (234 + 284))]
    assert [(r["grp"], r["copies"]) for r in near.collect()] == [("near-1", 2)]
    catalog.write_views()
    document = json.loads((catalog.folder / "catalog.json").read_text())
    assert document["counts"] == {"total": 8, "projects": 8, "archives": 0, "thumbnails_rendered": 0} and len(document["items"]) == 8
    page = (catalog.folder / "gallery.html").read_text()
    assert page.count("</script>") == 1 and "<b>" not in page.split("<script>")[1].replace("\\u003c", "<").split("const by")[0].replace('<b>\\"and', "")
    part = next((catalog.folder / "catalog_csv").glob("part-*.csv")).read_text().splitlines()
    assert part[0].split(",") == list(views.CSV_COLUMNS) and len(part) == 9
    spark = catalog.spark
    again = views.load_catalog(spark, f"file://{catalog.folder}/catalog.json")
    assert again.count() == 8 and set(again.columns) == {f.name for f in ITEM.fields}
    models_, images = views.tracker_import(catalog.items(), catalog.sources(), RULES, spark.createDataFrame([(document["items"][0]["id"], bytearray(b"x" * 200))], "id string, content binary"))
    assert models_.count() == 8 and len(images.first()["data"]) == 268
    counts, advice = catalog.diagnose(libraries=True)
    assert counts["hydrated"] == 8 and advice == "render"


def test_corrupt_catalog_fails_and_snapshots_restore(tmp_path, spark):
    (tmp_path / "c.json").write_text('{"items": [{"id": "1", "ty')
    with pytest.raises(Exception):
        views.load_catalog(spark, f"file://{tmp_path}/c.json").collect()
    snapshots = Snapshots(spark, tmp_path / "s", keep=3)
    for k in range(5):
        snapshots.save(spark.range(k + 1))
    assert len(snapshots.names()) == 3 and snapshots.load().count() == 5
    assert snapshots.restore() == "v00000004" and snapshots.load().count() == 4
    snapshots.restore("v00000005")
    assert snapshots.load().count() == 5
    with pytest.raises(FileNotFoundError):
        snapshots.restore("v1")


def test_atomic_write_keeps_the_old_file(tmp_path):
    def broken():
        yield "half"
        raise RuntimeError

    atomic_write(tmp_path / "f", ["old"])
    with pytest.raises(RuntimeError):
        atomic_write(tmp_path / "f", broken())
    assert (tmp_path / "f").read_text() == "old" and os.listdir(tmp_path) == ["f"]


def test_source_list(library, tmp_path):
    models, catalog = library
    assert catalog.add_source(str(models)) and not catalog.add_source(str(models / "none"))
    assert save_sources(tmp_path / "l", ["D:\\A\\", "d:\\a", " ", "E:/b"]) == ["D:\\A", "E:/b"] == load_sources(tmp_path / "l")
    catalog.scan()
    counts = {r["root"]: r["n"] for r in catalog.source_counts().collect()}
    assert counts == {str(models): 2}
    catalog.remove_source(str(models).upper())
    assert catalog.sources() == [] and catalog.items().count() == 2


def test_time_remaining_on_a_simulated_run(spark):
    import random

    rng = random.Random(7)
    sizes = sorted(10 ** rng.uniform(4.5, 8.5) for _ in range(300))
    t, rows = 0.0, []
    for k, size in enumerate(sizes):
        t += 1.5 + size / 1e6 * 0.4 * rng.uniform(0.8, 1.3)
        rows.append((1, k, int(size), t))
    fit = reports.running_fit(spark.createDataFrame(rows, "run int, k int, size long, elapsed double"), "k", "size", "elapsed")
    got = [(r["elapsed"], r["fresh"]) for r in fit.orderBy("k").collect() if r["fresh"] is not None]
    assert got[-1][1] == 0 and len(got) > 250
    assert sum(abs(t - e - f) for e, f in got) / len(got) < 0.15 * t
    assert reports.smoothed(fit, "k").first()["eta"] == 0


def test_streamed_listings(library, spark, tmp_path):
    from shelfmark.streaming.ingest import event_counts, ingest

    _, catalog = library
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in ({"dir": "/k/Ork x", "name": "a.stl", "size": 5}, {"dir": "/k/Ork x", "name": "b.stl", "size": 6}, {"dir": "/k", "name": "z.zip", "size": 1})))
    ingest(catalog, f"file://{folder}", f"file://{tmp_path}/cp").awaitTermination(60)
    assert {(r["name"], r["size_bytes"]) for r in catalog.items().collect()} == {("Ork x", 11), ("z", 1)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_pixels_of_the_gallery_query(spark):
    rows = spark.createDataFrame([(n, "c", f, "s", col, "", 0, 1, 0.1, "", "p/" + n, "failed", "", "x", 1, [], k) for k, (n, f, col) in enumerate([("b", "F", "é"), ("A", "", "a"), ("B", "F", "b"), ("a", "F", "A")])],
                                 "n string, c string, f string, s string, col string, bc string, p int, pc int, mb double, t string, path string, ts string, te string, pf string, nf int, tags array<string>, ord int")
    got = views.gallery_query(rows, group_by="col")
    assert [(r["col"], r["header"]) for r in got.collect()] == [("a", True), ("A", True), ("b", True), ("é", True)]
    assert [r["n"] for r in views.gallery_query(rows, faction="F", text="P/B").collect()] == ["b", "B"]
    assert [r["n"] for r in views.gallery_query(rows, per_page=3, page=1).collect()] == ["a"]
    assert views.gallery_query(rows, status="mesh").count() == 0 and views.gallery_query(rows, picture=False).count() == 4


def test_render_takes_previews_draws_and_says_why(library):
    models, catalog = library
    (models / "Shown").mkdir()
    (models / "Shown/preview.png").write_bytes(b"\x89PNG picture")
    stl(models / "Shown/x.stl", 1)
    stl(models / "Cad/part.step", 1)
    stl(models / "Big/huge.stl", 40_000)
    catalog.scan([str(models)])
    plan = {r["id"]: r for r in catalog.render(max_mb=1).collect()}
    got = by_name(catalog)
    assert {k: r["thumb_status"] for k, r in got.items()} == {"files": "pending", "Ork Nob": "pending", "Shown": "reused", "Cad": "unsupported", "Big": "too_big"}
    assert got["Big"]["thumb_error"] == "2 MB, limit 1 MB" and got["Cad"]["thumb_error"] == "no reader for .step"
    assert (catalog.folder / "thumbnails" / got["Shown"]["thumbnail"]).read_bytes() == b"\x89PNG picture"
    assert [plan[got[k]["id"]]["place"] is None for k in ("Cad", "Big", "Ork Nob")] == [True, True, False]
    os.remove(models / "Warhound Titan/files/body.stl")
    plan = catalog.render(draw={"mesh": lambda files: b"drawn" if "nob" not in files[0] else None})
    assert plan.where("status = 'reused'").count() == 0  # it has its picture
    got = by_name(catalog)
    assert (got["files"]["thumb_status"], got["files"]["thumb_error"]) == ("mesh", "drawn from 2 of 3 part(s)")
    assert got["Ork Nob"]["thumb_status"] == "failed" and got["Big"]["thumb_status"] == "mesh"
    catalog.write_views()
    imported = json.loads((catalog.folder / "import.json").read_text())
    assert imported["schema"] == 2 and len(imported["models"]) == 5 and len(imported["images"]) == 3


def test_a_file_at_a_projects_path_is_no_project(library):
    models, catalog = library
    catalog.scan([str(models)])
    shutil.rmtree(models / "Ork Nob")
    (models / "Ork Nob").write_text("a file now")
    assert catalog.relocate(prune=True)["dropped"] == 1


def test_configured_ignores_replace_the_defaults(library, spark):
    models, catalog = library
    stl(models / "__MACOSX/shown.stl", 1)
    stl(models / "Old/hidden.stl", 1)
    stl(models / "New/tmp_a.stl", 1)
    stl(models / "New/b.stl", 1)
    from shelfmark.functions.classify import load_rules

    catalog.rules = load_rules(spark, None, json.dumps({"ignore_folders": ["OLD "], "ignore_file_prefixes": ["tmp_"]}))
    catalog.scan([str(models)])
    got = by_name(catalog)
    assert "Old" not in got and got["__MACOSX"]["part_count"] == 1 and got["New"]["model_files"] == ["b.stl"]


def test_archive_pictures(tmp_path, library):
    models, catalog = library
    with zipfile.ZipFile(models / "Kit.zip", "w") as z:
        z.writestr("parts/body.stl", b"0" * 9)
        z.writestr("big.png", b"\x89PNG" + b"0" * 99)
        z.writestr("renders/preview.png", b"\x89PNG small")
        z.writestr("renders/preview_large.png", b"not a picture, but large")
    catalog.scan([str(models)])
    catalog.look_inside()
    kit = by_name(catalog)["Kit.zip"]
    assert kit["thumb_status"] == "reused" and (catalog.folder / "thumbnails" / kit["thumbnail"]).read_bytes() == b"\x89PNG small"
    with zipfile.ZipFile(models / "Kit.zip") as z:
        entries = [z.getinfo("big.png"), z.getinfo("renders/preview.png")]
        assert archives.picture(z, entries, cap=4) is None and archives.picture(z, entries[:1])[0] == "big.png"


def test_style_is_laid_over_the_local_rules(library):
    _, catalog = library
    path = catalog.set_style("night")
    path.write_text(json.dumps({"categories": {"a": "b"}, "thumbnail_style": {"preset": "x", "angle": 3}}))
    catalog.set_style("dawn")
    assert json.loads(path.read_text()) == {"categories": {"a": "b"}, "thumbnail_style": {"preset": "dawn", "angle": 3}}
    path.write_text("{broken")
    with pytest.raises(ValueError):
        catalog.set_style("dusk")
    assert path.read_text() == "{broken"


def test_duplicate_report_and_numbers(library, spark):
    models, catalog = library
    for k in range(3):
        stl(models / f"Copy {k}/body.stl", 3)
    catalog.scan([str(models)])
    lines = catalog.duplicate_report()
    assert lines[0] == "1 exact group(s), 2 extra, 0.00 GB" and lines[2] == "exact-1: 3 copies, 0 MB"
    from shelfmark.operators.numbering import numbered

    rows = numbered(spark.range(5000).repartition(7).withColumn("k", F.col("id") % 13), ["k", F.desc("id")], "n", first=10).collect()
    want = sorted(range(5000), key=lambda i: (i % 13, -i))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["n"])] == want and sorted(r["n"] for r in rows) == list(range(10, 5010))
    assert numbered(spark.range(0), ["id"]).count() == 0
