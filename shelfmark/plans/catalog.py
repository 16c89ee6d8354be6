"""The catalog's commands over operators and snapshots."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import Rules
from ..functions.scalars import segments
from ..operators import duplicates as dup
from ..operators import hydration, merge, relocate, reports, rollup
from ..operators.numbering import numbered
from ..operators.sources import root_counts, unreachable
from ..schema import IGNORED_DIRS, ITEM, SCANNED
from ..sources import archives, tree
from ..storage import materialize
from . import views
from .files import Snapshots, load_sources, save_local_rules, save_sources

Draw = Callable[[list[str]], bytes | None]


def drop_ignored(items: DataFrame, dirs: tuple[str, ...] = IGNORED_DIRS) -> DataFrame:
    """``items`` but for those with an ignored folder on their path."""
    low = F.transform(segments("path"), lambda p: F.lower(F.trim(p)))
    return items.where(~F.arrays_overlap(low, F.array(*map(F.lit, dirs))))


class Catalog:
    def __init__(self, spark: SparkSession, folder: Path, rules: Rules | None = None):
        self.spark, self.folder, self.rules = spark, Path(folder), rules or Rules()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.snapshots = Snapshots(spark, self.folder / "snapshots")

    # sources
    def sources(self) -> list[str]:
        return load_sources(self.folder / "sources.txt")

    def add_source(self, root: str) -> bool:
        """False if ``root`` is no folder."""
        if not os.path.isdir(root):
            return False
        save_sources(self.folder / "sources.txt", [*self.sources(), root])
        return True

    def remove_source(self, root: str) -> None:
        """Items of the root stay."""
        gone = root.strip().rstrip("\\/").lower()
        save_sources(self.folder / "sources.txt", [r for r in self.sources() if r.lower() != gone])

    def roots(self) -> DataFrame:
        rows = [(r, k, os.path.isdir(r)) for k, r in enumerate(self.sources())]
        return self.spark.createDataFrame(rows, "root string, ord int, reachable boolean")

    def source_counts(self) -> DataFrame:
        return root_counts(self.items(), self.roots())

    # state
    def items(self) -> DataFrame:
        found = self.snapshots.load()
        return self.spark.createDataFrame([], ITEM) if found is None else found

    def _save(self, items: DataFrame) -> str:
        return self.snapshots.save(items.select([f.name for f in ITEM.fields]))

    def restore(self, name: str | None = None) -> str:
        return self.snapshots.restore(name)

    # rules
    def set_style(self, preset: str) -> Path:
        """Record a colour scheme in the local rules, which overlay the shipped
        ones; a local file that can't be read is left alone (ValueError)."""
        return save_local_rules(self.folder / "rules.local.json", {"thumbnail_style": {"preset": preset}})

    # commands
    def scan(self, roots: list[str] | None = None) -> dict[str, int]:
        """Scan ``roots`` (all sources by default) and merge what is found."""
        roots = self.sources() if roots is None else roots
        for r in roots:
            self.add_source(r)
        listed = ("ignore_dirs", self.rules.ignored_dirs), ("ignore_prefixes", self.rules.ignored_prefixes)
        files = materialize(tree.scan(self.spark, roots, **{k: ",".join(v) for k, v in listed}), "files")
        old = self.items()
        new = rollup.items(files.where("not unreadable"), self.rules, self.roots())
        new = merge.keep_known_contents(old, new).dropDuplicates(["id"])
        top = old.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
        new = numbered(new, ["path", "id"], "ord", first=top + 1)
        merged = drop_ignored(merge.upsert(old, new, SCANNED), self.rules.ignored_dirs)
        before = old.count()
        self._save(merge.mark_rendered(merged, self.thumbnails()))
        after = self.items().count()
        return {"items": after, "added": after - before, "unreadable": files.where("unreadable").count()}

    def thumbnails(self) -> DataFrame:
        folder = self.folder / "thumbnails"
        names = [p.stem for p in folder.glob("*.webp")] if folder.exists() else []
        return self.spark.createDataFrame([(n,) for n in names], "id string")

    def _pictures(self) -> DataFrame | None:
        folder = self.folder / "thumbnails"
        if not folder.exists() or not any(folder.glob("*.webp")):
            return None
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.webp").load(f"file://{folder}")
        return files.select(F.regexp_extract("path", r"([^/]*)\.webp$", 1).alias("id"), "content")

    def mark_thumbnails(self) -> None:
        self._save(merge.mark_rendered(self.items(), self.thumbnails()))

    def relocate(self, prune: bool = False) -> dict[str, int]:
        items = self.items()
        here = materialize(self._present(items), "present")
        moved, plan = (materialize(df, "moves") for df in relocate.relocate(items, here))
        deduped = materialize(merge.dedupe_paths(moved), "deduped")
        out, counts = deduped, {"moved": plan.count(), "deduped": moved.count() - deduped.count(), "dropped": 0, "kept_unreachable": 0}
        for r in plan.where("survives").toLocalIterator():
            source = self.folder / "thumbnails" / f"{r['old_id']}.webp"
            if source.exists():
                os.replace(source, source.with_name(f"{r['new_id']}.webp"))
        if prune:
            flagged = materialize(unreachable(deduped, self.roots()), "flagged")
            kept, gone = merge.prune(flagged, self._present(deduped))
            kept = materialize(kept, "kept")
            counts["dropped"] = gone.count()
            counts["kept_unreachable"] = kept.where("unreachable").count()
            out = kept.drop("unreachable")
        self._save(out)
        return counts

    def _present(self, items: DataFrame) -> DataFrame:
        """The paths where a project's folder, or an archive's file, is."""
        kinds = items.select("path", (F.col("type") == "project").alias("folder")).distinct()
        return archives.probe(kinds).where("is_dir is not null").join(kinds, "path").where("is_dir = folder")

    def reclassify(self, dry_run: bool = False) -> DataFrame:
        """What changes under the rules as they are; saved unless ``dry_run``."""
        diff = reports.reclassified(self.items(), self.rules, self.roots())
        if not dry_run and not diff.where("changed").isEmpty():
            self._save(diff.withColumns({c: F.col(f"new_{c}") for c in ("category", "faction", "source", "tags")}))
        return diff.where("changed")

    def _probe(self, items: DataFrame) -> DataFrame:
        """The state of all paths that rendering would open."""
        files = items.select(F.explode(F.transform("model_files", lambda f: F.concat("path", F.lit("/"), f))).alias("path"))
        own = items.where("type = 'archive'").select("path").unionByName(items.where("preview_file is not null").select(F.col("preview_file").alias("path")))
        return archives.probe(files.unionByName(own).distinct())

    def render(self, max_mb: float = 1500, force: bool = False, draw: dict[str, Draw] | None = None) -> DataFrame:
        """Give every project without a picture its outcome (id, place, status,
        detail). ``draw`` has engines by name: each takes the paths of a project's
        files on disk and gives picture bytes or null. They run in the executors,
        smallest project first; without one only shipped previews are taken over."""
        items = self.items().where("type = 'project'")
        plan = hydration.queue(items, materialize(self._probe(items), "probe"), self.thumbnails(), max_mb, force, tuple(draw or ()))
        plan = materialize(plan, "queue")
        state = items.select("id", "path", "preview_file", "model_files").join(plan.where("place is not null").select("id", "place", "status"), "id")
        made = materialize(_drawn(state.orderBy("place"), draw or {}), "pictures")
        for r in made.where("picture is not null").select("id", "picture").toLocalIterator():
            self._picture(r["id"], bytes(r["picture"]))
        drawn = made.select("id", F.col("done").alias("_done"))
        plan = plan.join(drawn, "id", "left").withColumns({"status": F.coalesce("_done", "status"), "detail": F.when(F.col("_done") == "failed", F.lit("no picture came of it")).otherwise(F.col("detail"))}).drop("_done", "size_bytes")
        learned = {"part_count": "int", "inner_bytes": "long", "model_files": "array<string>", "formats": "array<string>"}
        results = plan.select("id", "status", F.coalesce("detail", F.lit("")).alias("detail"), *[F.lit(None).cast(t).alias(c) for c, t in learned.items()])
        self._save(merge.attach_results(self.items(), results))
        return plan

    def _picture(self, item: str, data: bytes) -> None:
        folder = self.folder / "thumbnails"
        folder.mkdir(exist_ok=True)
        temp = folder / f".{item}"
        temp.write_bytes(data)
        os.replace(temp, folder / f"{item}.webp")

    def look_inside(self) -> None:
        """Record what archives hold, and take over the pictures in them, in
        their own format. Only what is on disk is opened."""
        items = self.items()
        packed = items.where("type = 'archive'").select("id", "path")
        state = hydration.skip_status(items.where("type = 'archive'"), archives.probe(packed))
        found = materialize(archives.contents(state.where("skip is null")).join(packed, "path"), "contents")
        for r in found.where("preview is not null").select("id", "path").toLocalIterator():
            self._picture(r["id"], archives.preview_bytes(r["path"]))
        none = self.spark.createDataFrame([], "part_count int, inner_bytes long, model_files array<string>, formats array<string>")
        skipped = state.where("skip is not null").select("id", F.col("skip").alias("status"), F.col("skip_detail").alias("detail"))
        self._save(merge.attach_results(items, found.drop("path", "preview").unionByName(skipped, allowMissingColumns=True).select("id", "status", "detail", *none.columns)))

    def duplicates(self, most: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Exact and near groups, all or the first ``most`` of each."""
        prints = dup.fingerprinted(self.items().where("type = 'project'"))
        exact = dup.exact_groups(prints)
        both = dup.ranked(exact, "exact"), dup.ranked(dup.near_groups(prints, exact), "near")
        return both if most is None else tuple(dup.reported(g, most) for g in both)

    def duplicate_report(self, most: int = 20, most_near: int = 5) -> list[str]:
        """What the duplicates command prints: totals, and the largest groups."""
        exact, near = self.duplicates()
        t = dup.totals(exact, near).first()
        out = [f"{t[f'{k}_groups']:,} {k} group(s), {t[f'{k}_extra']:,} extra, {t[f'{k}_waste'] / 1e9:.2f} GB" for k in ("exact", "near")]
        for groups, n in ((exact, most), (near, most_near)):
            out += [f"{r['grp']}: {r['copies']} copies, {r['waste'] / 1e6:,.0f} MB" for r in groups.where(F.col("place") <= n).orderBy("place").collect()]
        return out

    def unmatched(self, n: int = 25) -> DataFrame:
        return reports.unmatched_top(self.items(), self.rules.default_category, n).drop("path")

    def diagnose(self, libraries: bool = False) -> tuple[dict[str, int], str]:
        items = self.items()
        files = items.select(F.explode(F.transform("model_files", lambda f: F.concat("path", F.lit("/"), f))).alias("path"))
        counts = reports.diagnose_counts(hydration.parts_state(items, archives.probe(files.distinct()))).first().asDict()
        return counts, reports.advice(libraries, len(self.sources()), counts)

    def write_views(self) -> None:
        items, roots = self.items(), self.sources()
        views.write_pieces(views.catalog_json(items), self.folder / "catalog.json")
        views.write_csv(views.csv_rows(items, roots, self.rules), f"file://{self.folder}/catalog_csv")
        views.write_csv(views.duplicate_rows(items, roots, self.rules), f"file://{self.folder}/duplicates_csv")
        views.write_pieces(views.tracker_json(*views.tracker_import(items, roots, self.rules, self._pictures())), self.folder / "import.json")
        views.write_pieces(views.gallery_page(views.gallery_rows(items, roots, self.rules)), self.folder / "gallery.html")


def _drawn(rows: DataFrame, draw: dict[str, Draw]) -> DataFrame:
    """id, done (the engine that drew, ``reused``, or ``failed``), picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                here = [f for f in (os.path.join(r["path"], m) for m in r["model_files"] or []) if os.path.exists(f)]
                done, data = "failed", None
                if r["status"] == "reused":
                    done, data = "reused", Path(r["preview_file"]).read_bytes()
                for name, engine in draw.items():
                    if data is None and (data := engine(here)) is not None:
                        done = name
                out.append((r["id"], done if data is not None or draw else "pending", data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.binary()))], names=["id", "done", "picture"])

    return rows.mapInArrow(run, "id string, done string, picture binary")
