"""Steps from a command line: ``python -m loomfield STEP --data FOLDER [...]``.

A folder holds tables by name, each in numbered versions (``postings/v00001``); a step reads the last version of what it needs and writes the
next one, so a step that fails leaves all tables as they were, and one that runs again goes on from what is there.

    seed       boards + new rows of --input (ats, slug), in any case of letters            -> boards
    process    documents, quarantine, postings: pending documents become postings        -> postings, quarantine
    recheck    rules worked out anew where sources, models or people gave no value        -> postings
    decide     decisions of postings that another version decided                         -> postings
    skills     skills of postings that another version looked at; --input: the dictionary -> skills, postings
    liveness   polls (board_id, at, source_id) in order, guard included                   -> liveness
    linkcheck  --input (id, http_status) counted into links (id, dead_checks, dead)       -> links
    query      a registered query (--name) over the tables of --data as Parquet files     -> --output

Each step prints one line of counts.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import places
from loomfield.operators import ladder, skills, state
from loomfield.sources import snapshot


class Store:
    """Tables of a folder, in versions; the folder may be on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _last(self, name: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        kept = [s.getPath() for s in fs.listStatus(path)]
        # A version counts once Spark has put its mark beside the files.
        return max((int(p.getName()[1:]) for p in kept if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), default=0)

    def read(self, name: str) -> DataFrame | None:
        last = self._last(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v{last:05d}") if last else None

    def need(self, name: str) -> DataFrame:
        found = self.read(name)
        if found is None:
            raise SystemExit(f"{self.folder} has no table {name}")
        return found

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/v{self._last(name) + 1:05d}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def seed(store: Store, a: argparse.Namespace) -> dict:
    wanted, boards = store.spark.read.parquet(a.input), store.read("boards")
    new = snapshot.seed(boards if boards is not None else wanted.limit(0), wanted)
    done = store.write("boards", new if boards is None else boards.unionByName(new.select(boards.columns)))
    return {"boards": done.count(), "new": done.count() - (boards.count() if boards is not None else 0)}


def process(store: Store, a: argparse.Namespace) -> dict:
    postings, gazetteer = store.read("postings"), places.gazetteer(store.spark)
    documents = store.need("documents")
    if postings is None:
        good, bad = ladder.extract(documents, a.now, gazetteer)
        postings = good.limit(0)
    after, bad = ladder.process_documents(postings, documents, a.now, store.read("quarantine"), gazetteer)
    done, held = store.write("postings", after), store.write("quarantine", bad)
    return {"documents": documents.count(), "postings": done.count(), "quarantined": held.count()}


def recheck(store: Store, a: argparse.Namespace) -> dict:
    before = store.need("postings")
    after = ladder.recheck(before, gazetteer=places.gazetteer(store.spark))
    done = store.write("postings", after.select([c if c in after.columns else F.lit(None).alias(c) for c in before.columns]))
    return {"postings": done.count()}


def decide(store: Store, a: argparse.Namespace) -> dict:
    postings = store.need("postings")
    stale = state.pending(postings, "decision_key", F.lit(f"decide:{ladder.VERSION}")).count()
    return {"postings": store.write("postings", ladder.decide_pending(postings)).count(), "decided": stale}


def find_skills(store: Store, a: argparse.Namespace) -> dict:
    postings, stored = store.need("postings"), store.read("skills")
    if "skills_key" not in postings.columns:
        postings = postings.withColumn("skills_key", F.lit(None).cast("string"))
    if stored is None:
        stored = store.spark.createDataFrame([], "raw_document_id long, skill string, importance string, evidence string")
    found, after = skills.find_pending(postings, stored, "raw_document_id", "title", "description", store.spark.read.parquet(a.input))
    return {"skills": store.write("skills", found).count(), "postings": store.write("postings", after).count()}


def liveness(store: Store, a: argparse.Namespace) -> dict:
    done = store.write("liveness", state.fold_polls(store.need("polls"), "board_id", "source_id", "at"))
    return {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}


def linkcheck(store: Store, a: argparse.Namespace) -> dict:
    links = store.need("links").join(store.spark.read.parquet(a.input).select("id", "http_status"), "id", "left")
    checks, dead = state.next_link_state(F.col("dead_checks"), F.col("http_status"))
    seen = F.col("http_status").isNotNull()
    done = store.write("links", links.select("id", F.when(seen, checks).otherwise(F.col("dead_checks")).alias("dead_checks"), F.when(seen, dead).otherwise(F.col("dead")).alias("dead")))
    return {"links": done.count(), "dead": done.where("dead").count()}


def query(store: Store, a: argparse.Namespace) -> dict:
    from loomfield.plans import feed, intake, relational, texts, tracker, wording  # noqa: F401  they register their queries
    from loomfield.registry import QUERIES

    if a.name not in QUERIES:
        raise SystemExit(f"no query {a.name}; there are: {', '.join(sorted(QUERIES))}")
    QUERIES[a.name](store.spark, a.data).write.mode("overwrite").parquet(a.output)
    return {"rows": store.spark.read.parquet(a.output).count()}


STEPS: dict[str, Callable[[Store, argparse.Namespace], dict]] = {"seed": seed, "process": process, "recheck": recheck, "decide": decide, "skills": find_skills, "liveness": liveness, "linkcheck": linkcheck, "query": query}
NEEDS = {"seed": ("input",), "skills": ("input",), "linkcheck": ("input",), "query": ("name", "output"), "process": ("now",)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("--data", required=True)
    for name in ("input", "output", "name", "now"):
        parser.add_argument(f"--{name}")
    a = parser.parse_args(argv)
    for name in NEEDS.get(a.step, ()):
        if getattr(a, name) is None:
            parser.error(f"{a.step} needs --{name}")
    spark = spark or SparkSession.builder.appName(f"loomfield {a.step}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps({"step": a.step} | STEPS[a.step](Store(spark, a.data), a)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
