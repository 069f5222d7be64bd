"""A store of units: a log-structured layout on Parquet.

    <path>/memtable-<n>/     appended batches, not laid out
    <path>/segment-<n>/      units with block_id, those of a block together; with codes if configured
    <path>/summary-<n>/      a row per block, with the files that hold it;  <path>/facets-<n>/  a row per block and value
    <path>/dead-<n>/         row_ids deleted
    <path>/manifest-<n>      JSON naming what is live; the greatest n counts

Files are only added, and a change takes effect with its manifest, so readers never see half of one.  A manifest is made
only where none of its number is, so of two writers of one version the later fails; one that cannot be read yet is passed over."""

from __future__ import annotations

import json
import time
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import conjunction
from ..functions.score import l2_normalize
from ..model import Config, ScoreSpec
from ..operators import assemble as asm
from ..operators import layout, search, summary
from ..operators.quantize import Quantizer
from ..plans.ql import parse


class Store:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._load()

    # --- manifest

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _load(self) -> dict:
        root = self._at(".")
        found = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        for version in sorted((int(n.split("-")[1]) for n in found if n.startswith("manifest-")), reverse=True):
            text = self.spark.read.text(f"{self.path}/manifest-{version}", wholetext=True).first()
            try:
                return json.loads(text[0])
            except (json.JSONDecodeError, TypeError):  # its writer is not done
                continue
        return {"version": 0, "next": 0, "memtable": [], "memtable_rows": 0, "segments": [], "dead": [], "columns": {}}

    def _commit(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        try:
            out = self._fs.create(self._at(f"manifest-{state['version']}"), False)
        except Py4JJavaError as e:
            raise RuntimeError("another writer has committed this version") from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.state = state

    def _number(self) -> int:
        self.state["next"] += 1
        return self.state["next"]

    # --- writing

    def insert(self, batch: DataFrame, **marks) -> None:
        """Appends units; row_ids are the caller's.  Rows deleted before stay so; the new ones are not.

        `marks` are noted in the manifest that makes the rows visible, so a writer can tell what it has inserted."""
        weights = F.forall(F.map_values("terms"), lambda w: w >= 0) if "terms" in batch.columns else F.lit(True)
        if not batch.where(~F.coalesce(weights, F.lit(True))).isEmpty():
            raise ValueError("term weights must not be negative: the bounds rest on it")
        name = f"memtable-{self._number()}"
        # -0.0 becomes the 0.0 that it equals: Parquet's filters tell the two apart
        zero = {f.name: (F.col(f"`{f.name}`") + F.lit(0.0)).cast(f.dataType) for f in batch.schema.fields if f.dataType.typeName() in ("float", "double")}
        batch.withColumns(zero | {"vec": l2_normalize(F.col("vec")).cast("array<float>")}).withColumn("_batch", F.lit(self.state["next"])).write.parquet(f"{self.path}/{name}")
        rows = self.spark.read.parquet(f"{self.path}/{name}").count()
        self._commit(memtable=[*self.state["memtable"], name], memtable_rows=self.state["memtable_rows"] + rows, **marks)
        if self.state["memtable_rows"] >= self.config.memtable_rows:
            self.flush()

    def delete(self, row_ids: DataFrame | list[int]) -> int:
        """Marks units as deleted; the number that were alive.  Summaries stay: bounds only loosen."""
        ids = row_ids if isinstance(row_ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in row_ids], "row_id long")
        name, number = f"dead-{self._number()}", self.state["next"]
        ids = ids.select("row_id").distinct()
        hit = self.units().join(ids, "row_id", "left_semi").select("row_id").count()
        ids.withColumn("_until", F.lit(number)).write.parquet(f"{self.path}/{name}")
        self._commit(dead=[*self.state["dead"], name])
        return hit

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows without those deleted after they were inserted."""
        if not self.state["dead"]:
            return rows
        dead = self.spark.read.parquet(*[f"{self.path}/{n}" for n in self.state["dead"]]).groupBy("row_id").agg(F.max("_until").alias("_until"))
        gone = (rows["row_id"] == dead["row_id"]) & (rows["_batch"] < dead["_until"])
        return rows.join(dead, gone, "left_anti")

    def _read(self, names: list[str]) -> DataFrame | None:
        frames = [self.spark.read.parquet(f"{self.path}/{n}") for n in names]
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
        return out

    def memtable(self) -> DataFrame | None:
        rows = self._read(self.state["memtable"])
        return None if rows is None else self._live(rows)

    def sealed(self) -> DataFrame | None:
        rows = self._read([s["units"] for s in self.state["segments"]])
        return None if rows is None else self._live(rows)

    def units(self) -> DataFrame:
        """All live units."""
        parts = [p for p in (self.memtable(), self.sealed()) if p is not None]
        if not parts:
            raise ValueError("the store is empty")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def flush(self) -> None:
        """Seals the memtable into a segment; nothing alive in it makes none."""
        rows = self.memtable()
        if rows is None:
            return
        made = self._segment(rows)
        self._commit(memtable=[], memtable_rows=0, segments=[*self.state["segments"], *made])
        if len(self.state["segments"]) > self.config.compact_threshold:
            self.compact()

    def compact(self) -> None:
        """One new segment of all live sealed units, laid out anew; deletions of sealed rows are then done with."""
        rows = self.sealed()
        if rows is None:
            return
        made = self._segment(rows)
        self._commit(segments=made, dead=self.state["dead"] if self.state["memtable"] else [])

    def _segment(self, rows: DataFrame) -> list[dict]:
        rows = rows.drop("block_id", "_code", "_scale")
        first = rows.select(F.size("vec").alias("d")).first()
        if first is None:
            return []
        c, n, d = self.config, self._number(), first["d"]
        made = {"units": f"segment-{n}", "summary": f"summary-{n}", "facets": None, "facet_columns": [], "quantizer": None, "sparse": "terms" in rows.columns}
        laid = layout.lay_out(rows, c.block_size, c.max_radius, c.partition_by, c.seed)
        laid = laid.withColumn("block_id", F.concat(F.lit(f"{n}:"), "block_id"))
        if c.quantize:
            z = Quantizer.fit(rows, c.seed)
            laid, made["quantizer"] = z.with_codes(laid), [z.d, z.eps, z.seed]
        # blocks come out whole, one after the other: no further shuffle
        laid.write.option("maxRecordsPerFile", c.file_rows).parquet(f"{self.path}/segment-{n}")
        units = self.spark.read.parquet(f"{self.path}/segment-{n}")
        fixed = {"row_id", "doc_id", "ordinal", "vec", "terms", "text", "block_id", "_batch", "_code", "_scale"}
        kinds = {f.name: f.dataType.typeName() for f in units.schema.fields if f.name not in fixed}
        numeric = [x for x, k in kinds.items() if k in ("double", "float", "integer", "long")]
        categorical = [x for x, k in kinds.items() if k in ("string", "integer") and x != "tokens"]
        place = F.concat(F.lit(f"segment-{n}/"), F.substring_index(F.input_file_name(), "/", -1))
        files = units.select("block_id", place.alias("f")).groupBy("block_id").agg(F.collect_set("f").alias("files"))
        blocks = summary.summarize(units, ["block_id"], d, numeric, categorical).join(files, "block_id")
        if made["sparse"]:
            sparse = summary.sparse_summary(summary.term_table(units, ["block_id"]), ["block_id"], c.lam, c.term_filter)
            blocks = blocks.join(sparse, "block_id", "left")
        blocks.write.parquet(f"{self.path}/summary-{n}")
        if c.facet_columns:
            made |= {"facets": f"facets-{n}", "facet_columns": list(c.facet_columns)}
            summary.facets(units, ["block_id"], list(c.facet_columns), d).write.parquet(f"{self.path}/facets-{n}")
        return [made]

    # --- reading

    def search(self, spec: ScoreSpec, k: int = 10, predicates=(), epsilon: float = 0.0, block_budget: int | None = None) -> search.Result:
        """Top-k over memtable and all segments in one order of bounds.  block_budget counts blocks over all."""
        spec = spec.bound()
        summaries, sealed = self._read([s["summary"] for s in self.state["segments"]]), self.sealed()
        memtable = self.memtable()
        if summaries is None:
            if memtable is None:
                raise ValueError("the store is empty")
            began = time.perf_counter()
            hits = search.top_k(memtable, spec, k, predicates)
            scores = [r.score for r in hits.collect()]
            return search.Result(hits, search.certify(scores, k, float("-inf")), search.SearchStats(), (time.perf_counter() - began) * 1e3)
        segments = self.state["segments"]
        # a facet counts where every segment has it
        shared = set.intersection(*[set(s["facet_columns"]) for s in segments])
        facets = self._read([s["facets"] for s in segments]).where(F.col("facet").isin(sorted(shared))) if shared else None
        # codes count where one quantizer made all; errors of several are bounded by the greatest
        made = [s["quantizer"] for s in segments]
        quantizer = None
        if spec.alpha and spec.dense and all(made) and len({(d, seed) for d, _, seed in made}) == 1:
            quantizer = Quantizer(made[0][0], max(eps for _, eps, _ in made), made[0][2])
        table = search.bounds(summaries, spec, predicates, facets)
        return search.pruned_top_k(sealed, table, spec, k, predicates, epsilon, block_budget, memtable, self._files, quantizer)

    def _files(self, files: list[str]) -> DataFrame:
        """The live rows of some files of segments."""
        by_segment: dict[str, list[str]] = {}
        for f in sorted(files):
            by_segment.setdefault(f.split("/")[0], []).append(f"{self.path}/{f}")
        out = None
        for names in by_segment.values():
            rows = self.spark.read.parquet(*names)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return self._live(out)

    def context(self, spec: ScoreSpec, budget_tokens: int = 2000, pool: int = 64, predicates=(), epsilon: float = 0.0, block_budget: int | None = None, bridge_gap: int = 1) -> search.Result:
        """A context pack from the `pool` best hits; neighbours that fill gaps obey deletions and predicates."""
        result = self.search(spec, pool, predicates, epsilon, block_budget)
        live = self.units().where(conjunction(predicates))
        hits = search.fetch(result.hits, live, ["doc_id", "ordinal", "tokens", "vec", "text"])
        units = asm.collect_units(hits)
        near = asm.neighbours_of(hits, live, bridge_gap).withColumn("score", F.lit(0.0))
        known = {(u.doc_id, u.ordinal): u for u in asm.collect_units(near)} | {(u.doc_id, u.ordinal): u for u in units}
        result.context = asm.assemble(units, budget_tokens, bridge_gap, known)
        return result

    def execute(self, statement: str, params: dict | None = None, now: float | None = None) -> search.Result:
        q = parse(statement)
        spec = q.bind(params or {}, now)
        if q.mode == "context":
            return self.context(spec, q.budget_tokens, max(q.k, 64), q.predicates, q.epsilon, q.block_budget)
        return self.search(spec, q.k, q.predicates, q.epsilon, q.block_budget)

    def lookup(self, doc_id: int, ordinal: int) -> DataFrame:
        return self.units().where((F.col("doc_id") == doc_id) & (F.col("ordinal") == ordinal))

    def stats(self) -> DataFrame:
        """One row: live units, segments, blocks, live memtable rows, bytes of summaries (facets among them)."""
        summaries, memtable = self._read([s["summary"] for s in self.state["segments"]]), self.memtable()
        blocks, size = summaries.agg(F.count(F.lit(1)), F.sum(summary.summary_bytes(summaries))).first() if summaries is not None else (0, 0)
        for name in [s["facets"] for s in self.state["segments"] if s["facets"]]:
            facets = self.spark.read.parquet(f"{self.path}/{name}")
            size += facets.agg(F.sum(summary.summary_bytes(facets))).first()[0] or 0
        waiting = memtable.count() if memtable is not None else 0
        rows = (self.sealed().count() if summaries is not None else 0) + waiting
        return self.spark.createDataFrame([(rows, len(self.state["segments"]), blocks, waiting, size, size / max(1, rows))], "rows long, segments long, blocks long, memtable_rows long, summary_bytes long, summary_bytes_per_row double")

    def describe(self) -> dict:
        return {"config": asdict(self.config), **self.state}
