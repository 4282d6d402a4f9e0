"""The engine: tables that age, behind one object."""

from __future__ import annotations

import base64
import contextlib
import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.codec import Layout, TierKind
from ebbline.operators import dml, lifecycle, load, maintain
from ebbline.operators.store import RoutingError, Store
from ebbline.plans import explain as plans
from ebbline.plans.modes import Kind, Mode
from ebbline.plans.predicates import Side
from ebbline.plans.seam import Seam
from ebbline.sources.files import TIER
from ebbline.streaming import mirror as streaming

#: A cut-line below every key: nothing is cold yet.
LOWEST = -(1 << 63)


class Engine:
    """root: a folder that driver and executors share (any store Spark reaches). catalog: a file on the driver."""

    def __init__(self, spark: SparkSession, root: str, catalog: str | None = None):
        self.spark = spark
        self.store = Store.open(spark, root, catalog)

    # Registration

    def register(
        self, name: str, schema: str | T.StructType, pk: list[str], tier_key: str, mode: str = "tiered", *, width: str | int = 0, lag: str | int | None = None, layout: str | int | None = None,
        lake_retention: str | int | None = None, heap_retention: str | int | None = None, cut: object = None, policy: Mapping | None = None,
    ) -> None:
        """Register a table with a fixed schema, a primary key and a tier key. Durations as in TierKind.duration."""
        fields = load.schema_of(schema)
        if missing := [c for c in [*pk, tier_key] if c not in fields.names]:
            raise RoutingError(f"{name} has no column {', '.join(missing)}")
        if hidden := [c for c in fields.names if c.startswith("__")]:
            raise RoutingError(f"names that begin with __ are the engine's: {', '.join(hidden)}")
        kind, m = TierKind.of(fields[tier_key].dataType), Mode.parse(mode)
        if m.keep_heap and lake_retention or m.kind is Kind.MIRRORED and lake_retention:
            raise RoutingError(f"a {m} table has no lake retention")
        if m.heap_retention and not heap_retention:
            raise RoutingError("heap_retention needs its lag")
        maintain.Policy.of(dict(policy or {}))
        unit = Layout(layout if layout is not None else (kind.duration(width) or None))
        duration = lambda x: None if x is None else kind.duration(x)
        spec = {"schema": fields.jsonValue(), "pk": list(pk), "tier_key": tier_key, "mode": str(m), "width": kind.duration(width), "lag": duration(lag), "layout": unit.unit or unit.width or None, "lake_retention": duration(lake_retention), "heap_retention_lag": duration(heap_retention), "policy": dict(policy or {})}
        self.store.catalog.register(name, spec, LOWEST if cut is None else kind.parse(cut))

    def unregister(self, name: str) -> None:
        self.store.catalog.unregister(name)

    def clone(self, name: str, new: str) -> None:
        """A table of its own that begins with the same files."""
        self.store.catalog.clone(name, new)

    def add_partitions(self, name: str, bounds: list[tuple[object, object]]) -> int:
        return lifecycle.add_partitions(self.store, name, bounds)

    # Reads

    def seam(self, name: str) -> Seam:
        return self.store.seam(self.store.table(name))

    def read(self, name: str, where: str | None = None) -> DataFrame:
        """The table as of now. where: a condition; files and a side of the cut-line that it rules out aren't planned."""
        table = self.store.table(name)
        if where is None:
            return self.store.seam(table).view()
        seam, side = dml.seam_for(self.store, table, where)
        return seam.view(side).filter(where)

    @contextlib.contextmanager
    def pinned(self, name: str, ttl: float = 900.0) -> Iterator[Seam]:
        """A read that stays the same until it is closed: run its last action inside the block."""
        table = self.store.table(name)
        pin, line = self.store.catalog.pin(table.id, ttl)
        try:
            yield Seam(self.spark, self.store.catalog, table, line, pin=pin)
        finally:
            self.store.catalog.unpin(pin)

    def read_hybrid(self, name: str, lag: str | int, frontier: int | None = None, wait_ms: int = 5000) -> DataFrame:
        """A mirrored table with old rows from the lake; all from the hot set if the lake doesn't reach the frontier in time."""
        table = self.store.table(name)
        if table.mode.kind is not Kind.MIRRORED:
            raise RoutingError(f"{name} isn't mirrored")
        if frontier is not None and not streaming.wait_for(self.store, name, frontier, wait_ms):
            return self.store.seam(table).view()
        return self.store.seam(table).hybrid(table.kind.duration(lag))

    def token(self, seam: Seam) -> str:
        """A pinned read as text, for another driver on the same catalog. It holds as long as its pin."""
        line = seam.line
        if seam.pin is None:
            raise RoutingError("only a pinned read has a token")
        return base64.urlsafe_b64encode(json.dumps([seam.table.name, line.t, line.s, line.hot, line.delta, seam.pin]).encode()).decode()

    def from_token(self, token: str) -> Seam:
        try:
            name, t, s, hot, delta, pin = json.loads(base64.urlsafe_b64decode(token.encode()))
        except ValueError as e:
            raise RoutingError("not a token of a pinned read") from e
        if not self.store.catalog.pin_lives(pin):
            raise RoutingError("the token's read has ended: its files may be gone")
        table = self.store.table(name)
        return Seam(self.spark, self.store.catalog, table, replace(self.store.catalog.line(table.id), t=t, s=s, hot=hot, delta=delta), pin=pin)

    # Writes

    def transparent_writes(self, name: str, on: bool) -> None:
        """Whether plain inserts may hold rows below the cut-line (on by default); explicit upserts always may."""
        table = self.store.table(name)
        if not on and table.mode.hot_complete:
            raise RoutingError(f"a {table.mode} table has no cold writes to switch off")
        self.store.catalog.set_spec(table.id, table.spec | {"transparent": on})

    def add_columns(self, name: str, fields: str | T.StructType) -> None:
        """Add columns; rows written before have nulls in them."""
        table, new = self.store.table(name), load.schema_of(fields)
        if clash := [c for c in new.names if c in table.columns or c.startswith("__")]:
            raise RoutingError(f"{name} can't add {', '.join(clash)}")
        self.store.catalog.set_spec(table.id, table.spec | {"schema": T.StructType([*table.schema.fields, *new.fields]).jsonValue()})

    def set_policy(self, name: str, **overrides) -> maintain.Policy:
        """Override a table's maintenance policy; what it is then."""
        table = self.store.table(name)
        policy = {**(table.spec.get("policy") or {}), **overrides}
        out = maintain.Policy.of(policy)
        self.store.catalog.set_spec(table.id, table.spec | {"policy": policy})
        return out

    def insert(self, name: str, rows: DataFrame) -> dict[str, int]:
        table = self.store.table(name)
        if not table.spec.get("transparent", True):
            t = self.store.catalog.line(table.id).t
            if self.store.prepared(table, rows).filter(f"{TIER} < {t}").take(1):
                raise RoutingError(f"{name}: rows below the cut-line, and transparent writes are off")
        return dml.insert(self.store, name, rows)

    def upsert(self, name: str, rows: DataFrame) -> dict[str, int]:
        return dml.upsert(self.store, name, rows)

    def delete(self, name: str, keys: DataFrame) -> dict[str, int]:
        return dml.delete(self.store, name, keys)

    def update(self, name: str, assign: Mapping[str, object], where: dml.Condition = None) -> tuple[dict[str, int], DataFrame]:
        return dml.update(self.store, name, assign, where)

    def delete_where(self, name: str, where: dml.Condition = None) -> tuple[dict[str, int], DataFrame]:
        return dml.delete_where(self.store, name, where)

    def delete_keys(self, name: str, keys: list) -> dict[str, int]:
        """Delete rows by keys as JSON has them: a scalar, or an object with a field for each column of the primary key."""
        table = self.store.table(name)
        wanted = []
        for k in keys:
            key = k if isinstance(k, Mapping) else {table.pk[0]: k}
            if set(key) != set(table.pk) or any(isinstance(v, Mapping | list) or v is None for v in key.values()):
                raise RoutingError(f"{name}: {k!r} isn't a key of {', '.join(table.pk)}")
            wanted.append(tuple(str(key[c]) for c in table.pk))
        if not wanted:
            return {"hot": 0, "delta": 0, "lake": 0}
        rows = self.spark.createDataFrame(wanted, T.StructType([T.StructField(c, T.StringType()) for c in table.pk]))
        rows = rows.select(*[F.col(f"`{c}`").cast(table.schema[c].dataType).alias(c) for c in table.pk])
        return dml.delete(self.store, name, self.read(name).join(F.broadcast(rows), table.pk, "left_semi").select(*dict.fromkeys([*table.pk, table.tier_key])))

    def holds(self, name: str, low: object, high: object) -> bool:
        """Whether the lake may hold a row with a tier key in [low, high), by its manifests alone."""
        kind = self.store.table(name).kind
        return maintain.holds(self.store, name, kind.parse(low), kind.parse(high))

    def copy_from(self, name: str, path: str, **options) -> dict[str, int]:
        return load.copy_from(self.store, name, path, **options)

    def ingest(self, name: str, rows: DataFrame | list[str]) -> dict[str, int]:
        return load.ingest(self.store, name, rows)

    def ingest_jsonl(self, name: str, path: str) -> dict[str, int]:
        return load.ingest(self.store, name, load.read_jsonl(self.store, name, path))

    def load(self, name: str, label: str, rows: DataFrame, spool_above: int = 1000) -> dict:
        return load.load(self.store, name, label, rows, spool_above)

    def load_jsonl(self, name: str, label: str, path: str, spool_above: int = 1000) -> dict:
        return load.load(self.store, name, label, load.read_jsonl(self.store, name, path), spool_above)

    # Ageing

    def tier(self, name: str) -> dict[str, int]:
        return lifecycle.tier(self.store, name)

    def reclaim(self, name: str, lag: int | None = None) -> int:
        return lifecycle.reclaim(self.store, name, lag)

    def compact(self, name: str, batch_rows: int = 1000) -> int:
        return lifecycle.compact(self.store, name, batch_rows)

    def retain(self, name: str) -> int | None:
        return lifecycle.retain(self.store, name)

    def retain_heap(self, name: str, head: int | None = None, frontier_seen: bool = False) -> int | None:
        return lifecycle.retain_heap(self.store, name, head, frontier_seen)

    def advance_frontier(self, name: str, position: int) -> None:
        """The feed has reached a position without changes for the table."""
        self.store.catalog.advance(self.store.table(name).id, f=position)

    def premake(self, name: str, headroom: int = 2) -> tuple[int, bool]:
        return lifecycle.premake(self.store, name, headroom)

    def adopt_loads(self, name: str) -> int:
        return load.adopt_loads(self.store, name)

    def initial_copy(self, name: str, chunk_rows: int = 50_000, max_chunks: int | None = None) -> dict:
        return load.initial_copy(self.store, name, chunk_rows, max_chunks)

    def mirror(self, name: str, feed: str, checkpoint: str, files_per_batch: int = 100, **options):
        return streaming.mirror(self.store, name, feed, checkpoint, files_per_batch, **options)

    def maintain(self, name: str) -> dict[str, int]:
        return maintain.maintain(self.store, name)

    def cycle(self) -> dict[str, dict]:
        """One round of the worker over all tables: partitions, tiering, folding, adoption, retention, maintenance."""
        out = {}
        for name in self.store.catalog.names():
            self.store.catalog.drop_expired_pins()
            mode = self.store.table(name).mode
            done: dict = {"premade": self.premake(name)[0]}
            if mode.kind is not Kind.MIRRORED:
                done["tier"] = self.tier(name)
                done["adopted"] = self.adopt_loads(name)
            if mode.kind is not Kind.DIRECT:
                done["folded"] = self.compact(name)
            done["retention"] = self.retain(name)
            done["maintained"] = self.maintain(name)
            out[name] = done
        return out

    def verify(self, name: str) -> dict:
        return maintain.verify(self.store, name)

    def status(self) -> DataFrame:
        return maintain.status(self.store)

    def partitions(self, name: str, limit: int = 200) -> DataFrame:
        """The newest partitions first."""
        got = [(p.name, p.lo, p.hi, p.state) for p in self.store.catalog.partitions(self.store.table(name).id)][::-1][:limit]
        return self.spark.createDataFrame(got, "name string, lo long, hi long, state string")

    def history(self, name: str, limit: int = 50) -> DataFrame:
        """The journal's newest operations first."""
        table = self.store.table(name)
        got = self.store.catalog.rows("SELECT kind, phase, seq, details, at FROM ops WHERE table_id = ? ORDER BY at DESC LIMIT ?", table.id, limit)
        return self.spark.createDataFrame([tuple(r) for r in got], "kind string, phase string, seq long, details string, at double")

    # SQL

    def preview(self, text: str, limit: int = 1000) -> tuple[list, bool]:
        """The first rows of a SELECT, and whether there are more."""
        if plans.parse(self.spark, text).kind != "select":
            raise RoutingError("a preview only reads")
        rows = self.sql(text).limit(limit + 1).collect()
        return rows[:limit], len(rows) > limit

    def sql(self, text: str) -> DataFrame:
        """Run a statement: tables in a SELECT are seam views; UPDATE, DELETE and INSERT are routed and return the rows."""
        s = plans.parse(self.spark, text)
        if s.kind == "select":
            self._views(s.tables)
            return self.spark.sql(text)
        self._views(s.tables[1:])
        if s.kind == "update":
            return self.update(s.tables[0], s.assign, s.where)[1]
        if s.kind == "delete":
            return self.delete_where(s.tables[0], s.where)[1]
        rows, table = plans.run(self.spark, s.query), self.store.table(s.tables[0])
        if not s.by_name:
            columns = s.columns or table.columns[: len(rows.columns)]
            if len(columns) != len(rows.columns):
                raise RoutingError(f"{len(rows.columns)} values for {len(columns)} columns")
            rows = rows.toDF(*columns)
        self.insert(s.tables[0], rows)
        return rows

    def _views(self, tables: list[str]) -> None:
        known = set(self.store.catalog.names())
        for name in tables:
            if name in known:
                self.read(name).createOrReplaceTempView(name)

    def explain(self, text: str) -> list[str]:
        """What a statement would do, rejections included; nothing is written."""
        if m := re.fullmatch(r"\s*copy\s+(\w+)\s+from\s+.*", text, re.I | re.S):
            table = self.store.table(m[1])
            return [f"copy into {m[1]} ({table.mode})", "each row is routed like an insert", *self._routes(m[1])]
        try:
            s = plans.parse(self.spark, text)
        except RoutingError as e:
            return [f"rejected: {e}"]
        known, out = set(self.store.catalog.names()), []
        for name in s.tables:
            if name not in known:
                out.append(f"{name}: not registered, left to Spark")
                continue
            table, line = self.store.table(name), self.store.catalog.line(self.store.table(name).id)
            out.append(f"{s.kind} {name} ({table.mode}): t={line.t} s={line.s} r={line.r} corrections={self.store.seam(table).delta_rows()}")
            if s.kind == "select":
                out.append("reads the hot set only" if table.mode.hot_complete else f"reads hot rows from t on, and {table.mode.cold.value} rows below")
            elif s.kind == "insert":
                out += self._routes(name)
            else:
                side = dml.side_of(self.store, table, s.where)
                out.append(f"the condition is {side.value}")
                if side is not Side.HOT and table.mode.kind is Kind.DIRECT:
                    out.append("rejected: rows below the cut-line of a direct table can't be updated in place")
                if set(s.assign) & set(table.pk):
                    out.append("rejected: a primary key can't be updated")
                if table.tier_key in s.assign:
                    out.append("rows may move over the cut-line")
        return out

    def _routes(self, name: str) -> list[str]:
        mode = self.store.table(name).mode
        show = lambda p: " + ".join(k for k in ("hot", "delta", "lake") if getattr(p, k)) + (", checked against r" if p.check_retention else "")
        return [f"at or above t: {show(mode.insert(True))}", f"below t: {show(mode.insert(False))}"]
