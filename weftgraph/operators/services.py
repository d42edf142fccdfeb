"""Driver-side services around the plans: versioned tables, caches, breakers, shards, registries, ontology, refinement."""

from __future__ import annotations

import json
import os
import random
import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions import constants as C
from weftgraph.functions.providers import json_objects  # noqa: F401
from weftgraph.sources.files import write_json


class VersionedTable:
    """A table as numbered parquet folders; a new version becomes current only when it is whole.

    The highest folder with a _SUCCESS mark is current, so no pointer can be
    torn. Readers keep the version they began with.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, fs = self._fs()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*/_SUCCESS")) or []
        return sorted(int(re.search(r"/v(\d+)/_SUCCESS$", str(f.getPath()))[1]) for f in found)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.versions()
        if not v:
            raise FileNotFoundError(f"no version under {self.path}")
        return self.spark.read.parquet(f"{self.path}/v{v[-1] if version is None else version}")

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = (), version: int | None = None) -> int:
        v = (self.versions() or [-1])[-1] + 1 if version is None else version
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v{v}")
        return v

    def vacuum(self, keep: int = 2) -> list[int]:
        jvm, fs = self._fs()
        old = self.versions()[:-keep]
        for v in old:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)
        return old


class TTLCache:
    """Least recently used values that expire; safe for threads."""

    def __init__(self, size: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.size, self.seconds, self.clock = size, seconds, clock
        self._data: OrderedDict = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key, make: Callable | None = None):
        with self._lock:
            got = self._data.get(key)
            if got is not None and self.clock() - got[0] < self.seconds:
                self._data.move_to_end(key)
                return got[1]
            self._data.pop(key, None)
        if make is None:
            return None
        value = make()
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        with self._lock:
            self._data[key] = (self.clock(), value)
            self._data.move_to_end(key)
            while len(self._data) > self.size:
                self._data.popitem(last=False)

    def purge(self, match: Callable[[object], bool] = lambda key: True) -> int:
        with self._lock:
            gone = [k for k in self._data if match(k)]
            for k in gone:
                del self._data[k]
        return len(gone)


class Breaker:
    """An instance counts as offline for `seconds` after a failure."""

    def __init__(self, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._failed = seconds, clock, {}

    def open(self, name: str) -> bool:
        return name in self._failed and self.clock() - self._failed[name] < self.seconds

    def trip(self, name: str) -> None:
        """Count an instance as offline from now on."""
        self._failed[name] = self.clock()

    def call(self, name: str, work: Callable):
        if self.open(name):
            raise ConnectionError(f"{name} is offline")
        try:
            out = work()
        except Exception:
            self._failed[name] = self.clock()
            raise
        self._failed.pop(name, None)
        return out


def run_shards(work: dict[str, Callable[[], list[str]]], seconds: float = 5.0, breaker: Breaker | None = None) -> list[dict]:
    """Results in the order given: shard, status (ok, timeout, offline, error), facts. Facts are first seen over answering shards."""
    pool = ThreadPoolExecutor(max(1, len(work)))
    guard = breaker or Breaker()
    jobs = [(name, pool.submit(guard.call, name, f)) for name, f in work.items()]
    out, seen, end = [], set(), time.monotonic() + seconds
    for name, job in jobs:
        status, facts = "ok", []
        try:
            facts = [f for f in job.result(max(0.0, end - time.monotonic())) if not (f in seen or seen.add(f))]
        except FutureTimeout:
            status = "timeout"
        except ConnectionError:
            status = "offline"
        except Exception:
            status = "error"
        out.append({"shard": name, "status": status, "facts": facts})
    pool.shutdown(wait=False, cancel_futures=True)
    return out


class BuildLocks:
    """One build per graph at a time."""

    def __init__(self):
        self._busy, self._lock = set(), threading.Lock()

    def acquire(self, kg: object) -> bool:
        with self._lock:
            if kg in self._busy:
                return False
            self._busy.add(kg)
            return True

    def release(self, kg: object) -> None:
        with self._lock:
            self._busy.discard(kg)


def backoff(attempt: int, limited: bool = False, rng: random.Random | None = None) -> float:
    """Seconds before the next attempt: 2 ** attempt and some jitter, from 20 on when the rate was limited."""
    jitter = (rng or random).random()
    return (20.0 + 10 * attempt if limited else float(2**attempt)) + jitter


class Ontology:
    """Entity and relation types: the fixed ones and those added globally or per graph, at most `most` per call."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                self.data = json.load(f)
        except (OSError, ValueError):
            self.data = {}
        self.data.setdefault("global", {"entity_types": [], "rel_types": []})
        self.data.setdefault("kg", {})

    def effective(self, kind: str, kg: str | None = None) -> list[str]:
        base = list(C.TYPE_LABELS) if kind == "entity_types" else list(C.REL_TYPES)
        extra = self.data["global"].get(kind, []) + self.data["kg"].get(str(kg), {}).get(kind, [])
        return base + [x for x in dict.fromkeys(extra) if x not in base]

    def add(self, kind: str, names: list[str], kg: str | None = None, most: int = 3) -> list[str]:
        new = [n for n in dict.fromkeys(names) if n not in self.effective(kind, kg)][:most]
        place = self.data["global"] if kg is None else self.data["kg"].setdefault(str(kg), {})
        place.setdefault(kind, []).extend(new)
        write_json(self.path, self.data)
        return new


class Subscriptions:
    """Remote graphs that are copied locally: (kb_id -> record) in one JSON store."""

    def __init__(self, path: str):
        self.path = path
        try:
            with open(path, encoding="utf-8") as f:
                self.rows = json.load(f)
        except (OSError, ValueError):
            self.rows = {}

    def add(self, kb_id: str, uri: str, hours: int = 6) -> dict:
        if kb_id in self.rows:
            raise ValueError(f"already subscribed to {kb_id}")
        self.rows[kb_id] = {"kb_id": kb_id, "uri": uri, "interval_hours": hours, "status": "active", "last_sync_at": None, "error_msg": None}
        write_json(self.path, self.rows)
        return self.rows[kb_id]

    def remove(self, kb_id: str) -> bool:
        found = self.rows.pop(kb_id, None) is not None
        write_json(self.path, self.rows)
        return found

    def set_status(self, kb_id: str, status: str, error: str | None = None, at: str | None = None) -> None:
        self.rows[kb_id] |= {"status": status, "error_msg": error, "last_sync_at": at or self.rows[kb_id]["last_sync_at"]}
        write_json(self.path, self.rows)

    def due(self) -> list[dict]:
        return [r for r in self.rows.values() if r["status"] != "paused"]


def refine(answer: Callable[[list[str]], tuple[str, float]], chunks: list[str], start: int = 3, per_round: int = 3, rounds: int = 3, enough: float = 0.65) -> tuple[str, float, int]:
    """Ask again with more chunks while the confidence is low; the best answer, its confidence and the rounds used."""
    used = start
    text, conf = answer(chunks[:used])
    best, n = (text, conf), 0
    while best[1] < enough and n < rounds and used < len(chunks):
        n, used = n + 1, used + per_round
        text, conf = answer(chunks[:used])
        if conf > best[1]:
            best = (text, conf)
    return best[0], best[1], n


def deepen(facts: Callable[[int], list], hops: int, least: int = 3, most: int = 3) -> tuple[list, int]:
    """Facts within `hops`; one hop more if they are fewer than `least` and the limit allows."""
    got = facts(hops)
    if len(got) < least and hops < most:
        return facts(hops + 1), hops + 1
    return got, hops


def events(kind: str, items: Iterator[dict]) -> Iterator[str]:
    """Server-sent event lines of numbered payloads."""
    for seq, item in enumerate(items):
        yield f"event: {kind}\ndata: {json.dumps({'seq': seq} | item, ensure_ascii=False)}\n\n"


def slug(name: str) -> str:
    """A database name part: lower-case letters, digits and hyphens."""
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "kg"


def bounded(name: str, value, low, high):
    """value, if it lies in the bounds of a request field; else an error that names it."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value


def free_name(folder: str, name: str) -> str:
    """name, or name with _1, _2, ... before its suffix if it is taken."""
    stem, suffix = os.path.splitext(name)
    n, out = 0, name
    while os.path.exists(os.path.join(folder, out)):
        n += 1
        out = f"{stem}_{n}{suffix}"
    return out


def move_then(path: str, folder: str, ingest: Callable[[str], object]):
    """Move a file into folder, ingest it there, and move it back if that fails."""
    target = os.path.join(folder, free_name(folder, os.path.basename(path)))
    os.replace(path, target)
    try:
        return ingest(target)
    except Exception:
        os.replace(target, path)
        raise


def rag_prompt(question: str, contexts: list[str], history: list[tuple[str, str]] = (), total: int = 7500, least: int = 500, turns: int = 4) -> str:
    """Question, last turns and numbered contexts, each cut to its share of the character budget."""
    share = max(least, total // max(1, len(contexts)))
    past = "".join(f"{role}: {text}\n" for role, text in list(history)[-2 * turns :])
    docs = "".join(f"[文件 {i}]\n{c[:share]}\n\n" for i, c in enumerate(contexts, 1))
    return f"{past}{docs}問題：{question}\n"


def federated_query(shards: dict[str, Callable[[list[str]], list[str]]], terms: list[str], expand: Callable[[list[str]], list[str]], local: set[str], seconds: float = 5.0, breaker: Breaker | None = None) -> tuple[list[str], list[dict]]:
    """(facts, results by shard): the expanded terms are asked of all shards at once.

    Facts are first seen over the shards that answer, in the order given; a
    shard that is late, offline or fails has its status and no facts. A remote
    shard that failed or was late counts as offline for a while.
    """
    if not shards or not terms:
        return [], []
    guard = breaker or Breaker()
    asked = expand(terms)
    results = run_shards({name: (lambda f=f: f(asked)) for name, f in shards.items()}, seconds, guard)
    for r in results:
        if r["status"] == "timeout" and r["shard"] not in local:
            guard.trip(r["shard"])
    return [f for r in results if r["status"] == "ok" for f in r["facts"]], results


def federation_status(registry: list[dict], local: set[str], breaker: Breaker, asked: set[str], fetched_at: float | None = None) -> dict:
    """Every known shard with its counts and one of local, online, offline, pending; pending ones were not asked yet."""
    rows = []
    for skill in registry:
        kb = skill["kb_id"]
        status = "local" if kb in local else "offline" if breaker.open(kb) else "online" if kb in asked else "pending"
        rows.append({"kb_id": kb, "name": skill.get("name"), "instance_id": skill.get("instance_id"), "is_local": kb in local, "status": status, "entity_count": skill.get("entity_count", 0), "relation_count": skill.get("relation_count", 0)})
    return {"last_fetched": fetched_at, "remote_skill_count": len(registry), "shards": rows}


class Registry:
    """A remote registry behind a cache: fresh values at once, stale ones at once too while one thread fetches anew; failures keep the old."""

    def __init__(self, fetch: Callable[[], list[dict]], seconds: float = 1800.0, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.seconds, self.clock = fetch, seconds, clock
        self.value, self.at, self._lock, self._thread = None, None, threading.Lock(), None

    def _load(self) -> None:
        try:
            self.value, self.at = self.fetch(), self.clock()
        except Exception:  # an unreachable registry leaves what is known; the next call tries again
            self.value = self.value or []

    def get(self) -> list[dict]:
        with self._lock:
            if self.value is None:
                self._load()
            elif (self.at is None or self.clock() - self.at >= self.seconds) and not (self._thread and self._thread.is_alive()):
                self._thread = threading.Thread(target=self._load, daemon=True)
                self._thread.start()
        return self.value

    def close(self) -> None:
        if self._thread:
            self._thread.join(1.0)


def sync_subscriptions(store: Subscriptions, fetch: Callable[[dict], int], at: str, seconds: float = 60.0, most: int = 5) -> list[dict]:
    """Fetch all due subscriptions, at most `most` at once; each gets (kb_id, status, rows) and its record the time or the error.

    `fetch` copies one graph's facts into the store and returns their number.
    """
    due, out = store.due(), []
    with ThreadPoolExecutor(most) as pool:
        began: dict[str, float] = {}

        def work(row: dict) -> int:
            began[row["kb_id"]] = time.monotonic()
            return fetch(row)

        jobs = [(r, pool.submit(work, r)) for r in due]
        for row, job in jobs:
            kb = row["kb_id"]
            try:
                while not job.done():  # the limit counts from the start of the work, not of the wait
                    left = seconds - (time.monotonic() - began[kb]) if kb in began else 0.05
                    if left <= 0:
                        raise FutureTimeout
                    try:
                        job.result(min(left, 0.05))
                    except FutureTimeout:
                        if job.done():
                            raise
                rows = job.result()
                store.set_status(kb, "active", at=at)
                out.append({"kb_id": kb, "status": "ok", "rows": rows})
            except FutureTimeout:
                store.set_status(kb, "error", f"no answer within {seconds:.0f} s")
                out.append({"kb_id": kb, "status": "timeout", "rows": 0})
            except Exception as e:
                store.set_status(kb, "error", f"{type(e).__name__}: {e}"[:200])
                out.append({"kb_id": kb, "status": "error", "rows": 0})
    return out


class Watchers:
    """Running file streams by folder: add, stop, and what each is doing."""

    def __init__(self, start: Callable[[str], object]):
        self._start, self._queries = start, {}

    def add(self, folder: str) -> bool:
        if folder in self._queries and self._queries[folder].isActive:
            return False
        self._queries[folder] = self._start(folder)
        return True

    def stop(self, folder: str | None = None) -> list[str]:
        gone = [f for f in self._queries if folder in (None, f)]
        for f in gone:
            self._queries.pop(f).stop()
        return gone

    def status(self) -> dict[str, dict]:
        return {f: {"active": q.isActive, "message": q.status.get("message") if hasattr(q, "status") else None} for f, q in self._queries.items()}


def cluster_plan(items: list[dict], propose: Callable[[list[dict]], list[dict]], smallest: int = 1) -> list[dict]:
    """A preview of groups for items (id, title): the provider sees short numbers and proposes (name, members); what it leaves out is one more group.

    Members that are no numbers of items or were used before are dropped.
    """
    proposals = propose([{"id": n, "title": i["title"]} for n, i in enumerate(items)])
    free, out = set(range(len(items))), []
    for p in proposals:
        mine = [n for n in dict.fromkeys(p.get("members", [])) if isinstance(n, int) and n in free]
        if len(mine) >= smallest and str(p.get("name", "")).strip():
            free -= set(mine)
            out.append({"name": str(p["name"]).strip(), "ids": [items[n]["id"] for n in mine]})
    if free:
        out.append({"name": "", "ids": [items[n]["id"] for n in sorted(free)]})
    return out


def confirm_plan(plan: list[dict], create: Callable[[str], object], link: Callable[[object, list], object]) -> list[tuple[str, object]]:
    """Create a graph for each named group of a confirmed plan and link its documents; (name, graph) in order."""
    made = []
    for group in plan:
        if group["name"] and group["ids"]:
            kg = create(group["name"])
            link(kg, group["ids"])
            made.append((group["name"], kg))
    return made


def world_prompt(question: str, facts: list[str], docs: list[tuple[str, str]], total: int = 4000) -> str:
    """Question, facts by shard order and titled passages for an answer over several graphs, within the character budget."""
    lines, left = [], total
    for f in facts:
        if len(f) + 1 > left:
            break
        lines.append(f"- {f}")
        left -= len(f) + 1
    share = left // max(1, len(docs))
    passages = "".join(f"《{title}》\n{text[:share]}\n\n" for title, text in docs)
    return "\n".join(lines) + f"\n\n{passages}問題：{question}\n"


def reclassify(edges: list[dict], decide: Callable[[list[dict]], list[str]], known: tuple[str, ...] = C.REL_TYPES, size: int = 10, dry: bool = False) -> tuple[list[dict], int]:
    """(changes, batches): relation types that a provider gives to edges (verb, ...), `size` at a time; unknown answers change nothing.

    With `dry` the changes are counted and not returned.
    """
    changes, batches = [], 0
    for at in range(0, len(edges), size):
        part = edges[at : at + size]
        batches += 1
        for e, new in zip(part, decide(part), strict=False):
            if new in known and new != e.get("rel_type"):
                changes.append(e | {"new_type": new})
    return ([] if dry else changes), batches


def every(hours: float, last: float | None, now: float) -> bool:
    """Whether a scheduled job is due."""
    return last is None or now - last >= hours * 3600
