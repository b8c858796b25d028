"""A memory store over an append-only log: validated appends under a lock, views, search with expansion and snippets, context.

The log is JSON lines; one writer appends at a time (a lock file made exclusively, with its owner in it), and readers see whole
lines only. All reading is DataFrames: the active view, lookups, timelines, full-text search over a written index that is rebuilt when
the log has changed.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions.text import ascii_tokens
from quillon.operators import audit, evidence as ev, packing, ranking
from quillon.sources import index as ix, logs

FIELDS = {"title": 4.0, "summary": 2.0, "body": 1.0}
#: Fields that only evaluation may see.
HIDDEN = ("gold", "expected", "split")


class Lock:
    """A lock file: made exclusively, broken when older than `stale` seconds, removed only by its owner."""

    def __init__(self, path: Path, stale: float = 60.0, patience: float = 10.0):
        self.path, self.stale, self.patience, self.owner = path, stale, patience, uuid.uuid4().hex

    def __enter__(self):
        until = time.time() + self.patience
        while True:
            try:
                with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(self.owner)
                return self
            except FileExistsError:
                try:
                    if time.time() - self.path.stat().st_mtime > self.stale:
                        self.path.unlink(missing_ok=True)
                        continue
                except FileNotFoundError:
                    continue
                if time.time() > until:
                    raise TimeoutError(f"{self.path} is held by another writer") from None
                time.sleep(0.02)

    def __exit__(self, *_):
        try:
            if self.path.read_text() == self.owner:
                self.path.unlink()
        except FileNotFoundError:
            pass


def document_text(*fields: str):
    """The non-empty fields of a record, a line each."""
    return F.concat_ws("\n", *[F.when(F.trim(f) != "", F.col(f)) for f in fields])


def public(df: DataFrame, hidden: tuple[str, ...] = HIDDEN) -> DataFrame:
    """The table without what only evaluation may see."""
    return df.select(*[c for c in df.columns if c not in hidden])


class MemoryStore:
    """token_counter: text Column -> Column of tokens. embedder: texts -> vectors (optional); where it fails, search is lexical alone and says so."""

    def __init__(self, spark: SparkSession, folder: str, token_counter: Callable | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, glossary: DataFrame | None = None):
        self.spark, self.folder, self.log = spark, Path(folder), Path(folder) / "events.jsonl"
        self.folder.mkdir(parents=True, exist_ok=True)
        self.count = token_counter or (lambda c: F.ceil(F.length(c) / 4).cast("bigint"))
        self.embedder, self.glossary = embedder, glossary

    # --- writing

    def _append(self, event: dict) -> dict:
        line = json.dumps(event, ensure_ascii=False, sort_keys=True) + "\n"
        with Lock(self.folder / "events.lock"):
            known = {}
            if self.log.exists():
                for row in map(json.loads, filter(str.strip, self.log.read_text("utf-8-sig").splitlines())):
                    known[row["id"]] = row
            if event["id"] in known:
                raise ValueError(f"id {event['id']} exists")
            if (old := event.get("supersedes")) is not None:
                if old not in known:
                    raise ValueError(f"{old} is not in the log")
                if any(r.get("supersedes") == old for r in known.values()):
                    raise ValueError(f"{old} is superseded already")
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(line)
                f.flush()
                os.fsync(f.fileno())
        return event

    def _event(self, operation: str, kind: str, title: str, body: str, **more) -> dict:
        now = datetime.now(timezone.utc)
        at = now.strftime("%Y-%m-%dT%H:%M:%SZ")
        event = {"schema_version": 2, "id": more.pop("id", None) or f"PM-{now:%Y%m%d}-{uuid.uuid4().hex[:8]}", "operation": operation, "kind": kind, "title": title, "summary": "", "body": body, "tags": [], "source_refs": [], "confidence": "unknown", "status": "active", "created_at": at, "valid_from": at, "claim_class": "unclassified", "related_ids": []}
        unknown = set(more) - {*event, "supersedes", "supersession_kind", "supersession_reason"}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        event |= more
        frame = self.spark.createDataFrame([(1, *[event.get(c) for c in logs.EVENT.names])], f"line bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in logs.EVENT)}")
        broken = [r["rule"] for r in audit.row_violations(frame).collect()]
        if broken:
            raise ValueError(f"the event breaks {sorted(broken)}")
        return event

    def add(self, kind: str, title: str, body: str, **more) -> dict:
        """Creates an event; what breaks a rule of the log is refused."""
        return self._append(self._event("create", kind, title, body, **more))

    def supersede(self, old: str, kind: str, title: str, body: str, reason: str, revision: str = "unclassified", **more) -> dict:
        """An event that takes an active one's place."""
        return self._append(self._event("supersede", kind, title, body, supersedes=old, supersession_kind=revision, supersession_reason=reason, **more))

    # --- reading

    def events(self) -> DataFrame:
        """The log's events with their line; lines that are no events are left to verify()."""
        if not self.log.exists():
            return self.spark.createDataFrame([], logs.EVENT).withColumn("line", F.lit(0).cast("bigint"))
        rows, _ = logs.read_jsonl(self.spark, str(self.log), logs.EVENT)
        return rows.withColumn("line", F.monotonically_increasing_id())

    def active(self) -> DataFrame:
        log = self.events()
        return log.join(log.where("supersedes is not null").select(F.col("supersedes").alias("id")), "id", "left_anti")

    def get(self, id_: str) -> dict | None:
        rows = ev.lookup(self.events(), self.spark.createDataFrame([(id_,)], "id string"), "id", "supersedes").collect()
        return rows[0].asDict() if rows else None

    def timeline(self, limit: int = 20, kind: str | None = None) -> DataFrame:
        log = self.events() if kind is None else self.events().where(F.col("kind") == kind)
        return log.orderBy(F.col("created_at").desc(), F.col("line").desc()).limit(max(1, min(200, limit)))

    def _index_folder(self) -> str:
        return f"{ix.shared_folder(self.spark)}/memory-index/{self.folder.resolve().name}"

    def rebuild(self) -> str:
        """Writes the index of the active documents if it is missing or stale; returns its folder."""
        rows = self.active().select("id", document_text(*FIELDS).alias("text"))
        marked = self.spark.read.text(str(self.log)) if self.log.exists() else rows
        return ix.build_index(rows, "id", f"{self._index_folder()}/{ix.source_mark(marked)}")

    def search(self, text: str, limit: int = 10, kinds: tuple[str, ...] = (), expand: bool = True) -> DataFrame:
        """id, rank, score, title, snippet, expanded and degraded: the best active documents; the glossary adds terms of known tokens."""
        asked = self.spark.createDataFrame([(1, text)], "q int, text string")
        terms = asked.select("q", F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term"))
        if expand and self.glossary is not None:
            terms = ev.expanded(terms, self.glossary, "q").select("q", "term")
        rows = self.active() if not kinds else self.active().where(F.col("kind").isin(*kinds))
        found = ix.read_index(self.spark, self.rebuild(), "id")
        lexical = ranking.bm25(terms, found, "q", "id")
        degraded = False
        if self.embedder is not None:
            try:
                vectors = self._vectors(rows, text)
                fused = ranking.reciprocal_rank_fusion([ranking.top(lexical, 50, "q", "id"), vectors], "q", "id")
                lexical = fused
            except Exception:  # noqa: BLE001  an embedder is the user's: its failure must not cost the answer
                degraded = True
        best = ranking.top(lexical.join(rows.select("id"), "id", "left_semi"), max(1, min(50, limit)), "q", "id")
        listed = terms.groupBy("q").agg(F.collect_set("term").alias("terms"))
        full = best.join(rows.select("id", "title", document_text(*FIELDS).alias("text")), "id").join(listed, "q")
        shown = ev.snippets(full, "q", "id", "text", "terms").select("id", "snippet")
        return full.join(shown, "id").select("id", "rank", "score", "title", "snippet", F.lit(bool(expand and self.glossary is not None)).alias("expanded"), F.lit(degraded).alias("degraded"))

    def _vectors(self, rows: DataFrame, text: str) -> DataFrame:
        embed = self.embedder

        def run(frames):
            for pdf in frames:
                yield pdf.assign(v=[list(map(float, v)) for v in embed(pdf["text"].tolist())])[["id", "v"]]

        own = rows.select("id", document_text(*FIELDS).alias("text")).mapInPandas(run, "id string, v array<double>")
        asked = [float(x) for x in embed([text])[0]]
        q = F.array(*map(F.lit, asked))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
        scored = own.select(F.lit(1).alias("q"), "id", (dot("v", q) / F.sqrt(dot("v", "v") * dot(q, q))).alias("score"))
        return ranking.top(scored, 50, "q", "id")

    def context(self, text: str, budget: int = 4000, limit: int = 10) -> str:
        """The best documents for a text, as whole items, until the budget (1,000 to 50,000 characters) is full."""
        budget = max(1000, min(50_000, budget))
        found = self.search(text, limit).join(self.active().select("id", document_text(*FIELDS).alias("text")), "id").withColumn("g", F.lit(1)).withColumn("chars", F.length("text") + 1)
        return "\n".join(r["text"] for r in packing.prefix_fill(found, "g", "rank", "chars", budget).orderBy("rank").collect())

    def verify(self) -> DataFrame:
        """line, id and rule of every violation of the log."""
        return audit.log_violations(self.events())

    def status(self) -> dict:
        log = self.events()
        row = log.agg(F.count("*").alias("events"), F.countDistinct("kind").alias("kinds")).first()
        return {"events": row["events"], "kinds": row["kinds"], "active": self.active().count()}


class MemorySystem:
    """The protocol of a memory under test: reset, ingest (ordered records), query (id, asked, text -> id and answer). validated() wraps
    one so that what it must not do is an error."""

    query_mutates_state = False

    def reset(self) -> None:
        raise NotImplementedError

    def ingest(self, records: DataFrame) -> None:
        raise NotImplementedError

    def query(self, questions: DataFrame) -> DataFrame:
        raise NotImplementedError


class Recent(MemorySystem):
    """Answers with the last record before the question."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.records = None

    def ingest(self, records: DataFrame) -> None:
        self.records = records if self.records is None else self.records.unionByName(records)

    def query(self, questions: DataFrame) -> DataFrame:
        both = questions.select("id", F.col("asked").alias("ts"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("text"))
        if self.records is not None:
            both = both.unionByName(self.records.select(F.lit(None).cast("bigint").alias("id"), "ts", F.lit(1).alias("side"), "text"))
        w = Window.partitionBy(F.lit(0)).orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, -1)  # an experiment's stream
        return both.withColumn("answer", F.last("text", ignorenulls=True).over(w)).where("side = 0").select("id", "answer")


def validated(system: MemorySystem, records: DataFrame, questions: DataFrame) -> list[str]:
    """What a system does that the protocol forbids (empty: nothing): unordered records accepted, answers missing, repeated or to other
    questions, answers that change when asked twice (unless it says so), answers that use later records, state left after reset."""
    faults = []
    back = records.withColumn("__b", F.max("ts").over(Window.partitionBy(F.lit(0)).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))).where("ts < __b")  # an experiment's stream
    if not back.isEmpty():
        return ["records are not in order"]
    system.reset()
    system.ingest(records)
    first = {r["id"]: r["answer"] for r in system.query(questions).collect()}
    ids = [r["id"] for r in questions.select("id").collect()]
    if set(first) != set(ids):
        faults.append("answers and questions differ")
    if system.query(questions).count() != len(ids):
        faults.append("a question has several answers")
    if not system.query_mutates_state and {r["id"]: r["answer"] for r in system.query(questions).collect()} != first:
        faults.append("asking changes the answers")
    cut = questions.agg(F.min("asked")).first()[0]
    earliest = questions.where(F.col("asked") == cut)
    system.reset()
    system.ingest(records.where(F.col("ts") < cut))
    if any(first.get(r["id"]) != r["answer"] for r in system.query(earliest).collect()):
        faults.append("an answer uses later records")
    system.reset()
    if any(r["answer"] is not None for r in system.query(questions).collect()):
        faults.append("a reset system still answers")
    return faults


TOOLS = ("status", "search", "context", "get", "timeline", "add", "supersede", "rebuild", "verify")


def call_tool(store: MemoryStore, name: str, arguments: dict):
    """One call of the tool surface: JSON in, JSON out."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}")
    out = getattr(store, name)(**arguments)
    return [r.asDict(recursive=True) for r in out.collect()] if isinstance(out, DataFrame) else out


def main(argv: list[str] | None = None) -> int:
    """The command line: python -m quillon.memory FOLDER TOOL [JSON arguments]."""
    import argparse

    parser = argparse.ArgumentParser(prog="quillon.memory", description="A memory store over an append-only log.")
    parser.add_argument("folder")
    parser.add_argument("tool", choices=TOOLS)
    parser.add_argument("arguments", nargs="?", default="{}", help="a JSON object")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    print(json.dumps(call_tool(MemoryStore(spark, args.folder), args.tool, json.loads(args.arguments)), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
