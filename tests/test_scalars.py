import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import classify as c
from shelfmark.functions import scalars as s
from shelfmark.functions.display import display_fields

ODD = ["  Mixed Case/Pfad\\é  ", "C:\\Kits\\A/b/", "\tx\u00a0", "\u2003wide\u3000", "", " ", "a.b.c", "..hidden", ".stl", "x.STL", "no_ext", "a/b.c/d", "100% y.z", "ſquig İ ẞ Σ", "nl\nin.obj", "...a.b", "x."]


def rows(spark, values, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")


def check(spark, values, column, want, kind="string"):
    got = {r["k"]: r["o"] for r in rows(spark, values, kind).select("k", column.alias("o")).collect()}
    for k, v in enumerate(values):
        assert got[k] == want(v), (v, got[k], want(v))


def norm(p):
    return p.strip().lower().replace("/", "\\").rstrip("\\")


def test_text_functions_equal_python(spark):
    values = [v for v in ODD if "İ" not in v] + [chr(k) + "x" + chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000]
    check(spark, values, s.ws_trim("v"), str.strip)
    check(spark, ODD, s.norm_path("v"), norm)
    check(spark, ODD, s.stable_id("v"), lambda v: hashlib.sha1(norm(v).encode()).hexdigest()[:16])
    check(spark, ODD, s.segments("v"), lambda v: [x for x in v.replace("/", "\\").split("\\") if x])


def test_extensions_equal_python(spark):
    rng = random.Random(3)
    values = [v.replace("/", "-") for v in ODD] + ["".join(rng.choice("ab.") for _ in range(rng.randint(0, 7))) for _ in range(500)]
    check(spark, values, s.raw_extension("v"), lambda v: os.path.splitext(v)[1][1:])
    check(spark, values, s.stem("v"), lambda v: os.path.splitext(v)[0])


def test_fingerprints(spark):
    values = [(["B.stl", " a.STL"], 5), ([], 1), (None, 1), (["a", "a"], None)]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, f array<string>, n long")
    got = df.orderBy("k").select(s.fingerprint("f", "n").alias("a"), s.loose_fingerprint("f").alias("b")).collect()
    h = lambda t: hashlib.md5(t.encode()).hexdigest()[:16]
    assert [tuple(r) for r in got] == [(h("a.stl|b.stl::2::5"), h("a.stl|b.stl::2")), (None, None), (None, None), (h("a|a::2::0"), h("a|a::2"))]


def test_numbers(spark):
    check(spark, [0, 49_999, 50_000, 149_999, 150_000, 1_250_000, 10**12 + 1], s.megabytes("v", 1), lambda v: (v + 50_000) // 100_000 / 10, "long")
    check(spark, [0, 4_999, 5_000, 15_000, 123_456_789], s.megabytes("v", 2), lambda v: (v + 5_000) // 10_000 / 100, "long")
    want = {0: "0s", 89: "89s", 90: "1m", 3600: "60m", 5399: "89m", 5400: "1h30m", 36_060: "10h01m", -5: "0s"}
    check(spark, list(want), s.duration("v"), want.get, "long")


def test_encodings(spark):
    from urllib.parse import quote

    check(spark, ["C:\\a b\\ü&~*+%.stl", "/x/y", "日本"], s.file_uri("v"), lambda v: "file:///" + quote(v.replace("\\", "/"), safe="/:"))
    check(spark, ["</script>", "a<b"], s.script_safe("v"), lambda v: v.replace("</", "<\\/"))


def haystack(files, cap):
    seen, total = [], 0
    for f in files:
        name = os.path.splitext(f)[0].lower().strip()
        if name and name not in seen:
            seen.append(name)
            total += len(name) + 1
            if total >= cap:
                break
    return " ".join(seen)


@pytest.mark.parametrize("cap", [1, 5, 6, 7, 11, 12, 4000])
def test_haystack_stops_with_the_stem_that_reaches_the_cap(spark, cap):
    values = [["abcde.stl", "ABCDE.obj", "fghij.stl", "k.stl"], [".stl", " a .x"], [], ["x" * 4100 + ".a", "y.a"]]
    check(spark, values, c.haystack(F.col("v"), cap), lambda v: haystack(v, cap), "array<string>")


def test_rules_overlay_and_faults(spark):
    shipped = '{"_comment": "x", "categories": {"_c": "y", "A": "a+", "Bad": "(", "N": 3}, "factions": {"F": "f"}, "default_category": "D", "generic_folder_names": [" Files "]}'
    with pytest.warns(UserWarning):
        rules = c.load_rules(spark, shipped, '{"factions": {}, "match_filenames": false}')
    assert rules.categories == [("A", "a+")] and rules.factions == [] and rules.default_category == "D" and not rules.match_filenames and rules.generic == ("files",)
    with pytest.warns(UserWarning):
        assert c.load_rules(spark, "{broken").categories == []


def test_classification_precedence(spark):
    rules = c.Rules(categories=[("Walls", r"\bwall\b"), ("Misc", "misc")], factions=[("Orks", r"\borks?\b"), ("Titans", "titan")], types=[("titan", "titan"), ("wall", "wall")], war_pattern="40k", war_category="War", default_category="Other")
    cases = [
        ("KitA", ["warhound_titan_body.stl"], ("War", "Titans", ["faction:Titans", "type:titan"])),
        ("Ork Boyz", ["ork_boy.stl", "wall_mount.stl"], ("War", "Orks", ["faction:Orks", "type:wall"])),
        ("wall", ["titan.stl"], ("War", "Titans", ["faction:Titans", "type:wall"])),
        ("plain", ["a wall.stl"], ("Walls", None, ["type:wall"])),
        ("thing 40K", [], ("War", None, [])),
        ("nothing", None, ("Other", None, [])),
    ]
    df = spark.createDataFrame([(k, n, n, f) for k, (n, f, _) in enumerate(cases)], "k int, path string, name string, f array<string>")
    got = df.orderBy("k").select(*c.classified(rules, "path", "name", "f").values()).collect()
    assert [tuple(r) for r in got] == [w for _, _, w in cases]
    rules.match_filenames = False
    assert df.where("k = 0").select(c.classified(rules, "path", "name", "f")["faction"]).first()[0] is None


def display(path, roots, generic):
    """A plain reading of the rules for names, collections and breadcrumbs."""
    parts = [x for x in path.replace("/", "\\").split("\\") if x]
    low = [x.strip().lower() for x in parts]
    if not parts:
        return path, "(none)", ""
    named = [k for k in range(len(parts)) if low[k] not in generic]
    name = parts[named[-1] if named else 0]
    index, size = -1, -1
    for r in roots:
        rs = [x for x in r.replace("/", "\\").split("\\") if x]
        if rs and rs[-1].strip().lower() in low and len(rs) > size:
            index, size = low.index(rs[-1].strip().lower()), len(rs)
    rest = range(index + 1, len(parts)) if index >= 0 else range(0)
    chosen = [k for k in rest if low[k] not in generic]
    collection = parts[chosen[0]] if chosen else (parts[-1] if len(rest) else "")
    crumbs = []
    for k in range(index + 1 if index >= 0 else max(1, len(parts) - 3), len(parts) - 1):
        if low[k] != name.strip().lower() and (not crumbs or low[k] != crumbs[-1].strip().lower()):
            crumbs.append(parts[k])
    return name, collection or "(none)", " › ".join(crumbs[-3:])


def test_display_fields(spark):
    rng = random.Random(4)
    words = ["models", "Files", "files ", "Titan", "stl", "Kits", "A", "b", "D:"]
    values = ["/".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(300)] + ["", "\\", "one"]
    for roots in ([], ["D:/models", "x\\Kits", "/stl"], ["a/b/Titan", "q/models"]):
        made = display_fields("v", roots, ("files", "stl"))
        got = rows(spark, values).orderBy("k").select(*made.values()).collect()
        for v, r in zip(values, got):
            assert tuple(r) == display(v, roots, {"files", "stl"}), (v, roots)
