"""A project as relations, and every report as DataFrames over them.

A file is parsed once; its nested row is written to the shared folder and all relations are views of it.
Reports hold one DataFrame a section and are lazy but for the loops over the graph.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..luau.extract import extract
from ..operators import churn as C
from ..operators import clones, flags, graph, health, resolve, scope
from ..session import materialize
from ..sources.config import Config, globs_regex

EPS = 1e-12


@dataclass
class HealthOptions:
    max_crap: float = 30.0
    max_cyclomatic: int = 20
    max_cognitive: int = 15
    max_unit_size: int = 60
    since_days: float = 180.0
    min_commits: int = 1
    now: int | None = None
    hotspots: bool = True
    targets: bool = True
    score: bool = True
    dupes: bool = True
    baseline: list[str] = field(default_factory=list)


class Project:
    def __init__(self, spark: SparkSession, files: DataFrame, config: Config | None = None, commits: DataFrame | None = None, strict: bool = True):
        """files(path, source); commits(path, ts) if there is a history. ``strict`` refuses files that do not parse."""
        self.spark, self.config = spark, config or Config()
        rx = globs_regex(self.config.ignore)
        every = files.select("path", "source")
        self.all_paths = every.select("path")
        self.sources = every.where(~F.col("path").rlike(rx)) if rx else every
        self.rows = materialize(extract(self.sources, tuple(self.config.suppressed_by)), "extracted")
        bad = [r[0] for r in self.rows.where("error IS NOT NULL").select("error").orderBy("path").limit(20).collect()]
        if bad and strict:
            raise ValueError("; ".join(bad))
        self.files = self.rows.select("path", "lines", S.is_test_path(F.col("path")).alias("is_test"))
        self.edges = materialize(resolve.edges(self.rows, self.all_paths), "edges")
        self.links = self.edges.where("`to` IS NOT NULL").select(F.col("from").alias("src"), F.col("to").alias("dst")).distinct()
        self.commits = commits if commits is not None else spark.createDataFrame([], "path string, ts long")
        self._memo: dict = {}

    def rel(self, column: str) -> DataFrame:
        """One relation of the extraction: path and the fields of its rows."""
        return self.rows.select("path", F.inline(column))

    def once(self, name: str, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def markers(self) -> DataFrame:
        return self.rel("markers")

    @property
    def fans(self) -> DataFrame:
        return graph.fan_counts(self.files.select(F.col("path").alias("node")), self.links).withColumnRenamed("node", "path")

    @property
    def key_refs(self) -> DataFrame:
        to = self.edges.where("`to` IS NOT NULL").select(F.col("from").alias("path"), "specifier", "to").distinct()
        return self.rel("key_refs").join(to, ["path", "specifier"]).select(F.col("path").alias("from"), "to", "key", "line").distinct()

    # -- list, suppressions, flags

    def listing(self) -> dict:
        kinds = F.when(F.col("kind") == "string_literal", 0).when(F.col("kind") == "dynamic", 1).otherwise(2)
        e = self.edges.select("from", "kind", "specifier", "to", "line")
        counts = e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("to").isNull()).alias("unresolved")).crossJoin(self.files.agg(F.count(F.lit(1)).alias("files")))
        return {
            "files": self.files.select("path").orderBy(F.split("path", "/")), "edges": e.where("`to` IS NOT NULL").orderBy("from", "line", "specifier"),
            "unresolved": e.where("`to` IS NULL").orderBy("from", "line", kinds), "counts": counts,
        }

    def suppressions(self) -> dict:
        m = self.markers
        return {"markers": m.orderBy("path", "line"), "totals": scope.marker_totals(m)}

    def flags(self) -> DataFrame:
        b = self.rows.select("path", F.posexplode("flags").alias("i", "f")).select("path", "f.line", "f.kind", "f.name", "f.detail", F.struct(F.lit(1).alias("a"), F.col("i").alias("b"), F.lit(0).alias("c")).alias("seq"))
        out = flags.first_of_each(flags.text_flags(self.sources).unionByName(b)).withColumn("rule", F.lit("feature-flag"))
        return scope.suppressed(out, self.markers, kind="rule").select("path", "line", "kind", "name", "detail").orderBy("path", "line", "name")

    # -- dead code

    def entries(self, extra: list[str] | None = None) -> DataFrame:
        """Entry modules: patterns, else init and main files, else code that nothing requires; and all tests."""
        patterns = [*self.config.entry, *(extra or [])]
        if patterns:
            found = self.files.where(F.col("path").rlike(globs_regex(patterns))).select("path")
            if found.isEmpty():
                raise ValueError(f"no file matches the entry patterns {patterns}")
        else:
            found = self.files.where(F.col("path").rlike(r"(^|/)(init|main)\.luau?$")).select("path")
            if found.isEmpty():
                found = self.fans.where("fan_in = 0").select("path").join(self.files.where("NOT is_test").select("path"), "path")
        return found.unionByName(self.files.where("is_test").select("path")).distinct()

    def cycles(self) -> DataFrame:
        """cycle: a closed walk on real edges for every component of mutual requires."""
        part = graph.scc(self.links)
        inner = self.links.join(part.toDF("src", "a"), "src").join(part.toDF("dst", "b"), "dst").where("a = b").select("a", "src", "dst")

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pairs = list(zip(pdf["src"], pdf["dst"]))
            members = sorted({x for p in pairs for x in p})
            return pd.DataFrame({"members": [members], "cycle": [graph.cycle_walk(members, pairs)]})

        return inner.groupBy("a").applyInPandas(walk, "members array<string>, cycle array<string>").orderBy("cycle")

    def boundaries(self) -> DataFrame:
        zones = self.config.boundaries
        empty = "from string, to string, line int, from_zone string, to_zone string"
        if not zones:
            return self.spark.createDataFrame([], empty)
        names = [z.name for z in zones]
        if any(not n.strip() for n in names) or len(set(names)) < len(names):
            raise ValueError("zone names must be present and unique")
        for z in zones:
            for a in z.allow_imports_from:
                if a != "*" and a not in names:
                    raise ValueError(f"zone {z.name} allows the unknown zone {a}")
        tests = [F.when(F.col("path").rlike(globs_regex(z.paths) or "(?!)"), F.lit(z.name)) for z in zones]
        members = self.files.select("path", F.explode(F.array_compact(F.array(*tests))).alias("zone")).select(F.col("path").alias("node"), "zone")
        allowed = [(z.name, n) for z in zones for n in names if n in z.allow_imports_from or "*" in z.allow_imports_from]
        e = self.edges.where("`to` IS NOT NULL").select(F.col("from").alias("src"), F.col("to").alias("dst"), "line")
        out = scope.zone_violations(e, members, self.spark.createDataFrame(allowed, "zone string, target string"))
        return out.select(F.col("src").alias("from"), F.col("dst").alias("to"), "line", "from_zone", "to_zone").distinct().orderBy("from", "line", "to", "from_zone", "to_zone")

    def dead_code(self, extra_entries: list[str] | None = None) -> dict:
        return self.once(f"dead{extra_entries}", lambda: self._dead(extra_entries))

    def _dead(self, extra: list[str] | None) -> dict:
        entries = materialize(self.entries(extra), "entries")
        reached = graph.reachable(self.links, entries.select(F.col("path").alias("node")))
        free = lambda df, kind: scope.suppressed(df.withColumn("kind", F.lit(kind)), self.markers)
        files = self.files.join(reached.withColumnRenamed("node", "path"), "path", "left_anti").select("path", F.lit(1).alias("line"), F.col("path").alias("name"))
        refs = self.key_refs
        exports = self.rel("exports")
        unused = scope.unused_keys(exports, refs.select(F.col("to").alias("path"), F.col("key").alias("name")), entries).select("path", "line", "name")
        reads = self.rows.select("path", F.explode("local_reads").alias("name"))
        local = self.rel("local_decls").where("NOT startswith(name, '_')").join(reads, ["path", "name"], "left_anti").select("path", "line", "name")
        types = self.rel("type_decls").join(self.rows.select("path", F.explode("type_refs").alias("name")), ["path", "name"], "left_anti").select("path", "line", "name")
        unused_exports = materialize(free(unused, "unused_export"), "unused-exports")
        counts = exports.groupBy("path").agg(F.count(F.lit(1)).alias("exports"))
        dead = unused_exports.groupBy("path").agg(F.count(F.lit(1)).alias("dead"))
        ratios = self.files.select("path").join(counts, "path", "left").join(dead, "path", "left").fillna(0, ["exports", "dead"])
        ratios = ratios.withColumn("dead_ratio", F.coalesce(F.col("dead") / F.nullif(F.col("exports"), F.lit(0)), F.lit(0.0)))
        cycles = self.cycles()
        marked = cycles.select(F.element_at("members", 1).alias("path"), F.lit(1).alias("line"), F.concat_ws(" -> ", "cycle").alias("name"), "members", "cycle")
        marked = materialize(free(marked, "circular_dependency").drop("kind"), "cycles")
        zones = self.boundaries().select(F.col("from").alias("path"), "line", F.concat_ws(" -> ", "from_zone", "to_zone").alias("name"), "to")
        order = ["path", "line", "name"]
        out = {
            "unused_files": free(files, "unused_file").orderBy(order), "unused_exports": unused_exports.orderBy(order), "unused_locals": free(local, "unused_local").orderBy(order),
            "unused_types": free(types, "unused_type").orderBy(order), "boundary_violations": free(zones, "boundary_violation").orderBy(order),
            "circular_dependencies": marked.orderBy("cycle"), "ratios": ratios, "entries": entries,
        }
        parts = [out[k].select(*order, F.lit(k).alias("section"), F.lit(i).alias("ordinal")) for i, k in enumerate(list(out)[:6])]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        out["findings"] = whole.orderBy("ordinal", *order)
        return out

    # -- clones

    def dupes(self, min_tokens: int | None = None, min_lines: int | None = None, min_occurrences: int = 2) -> dict:
        m = self.config.duplicates.min_tokens if min_tokens is None else min_tokens
        l = self.config.duplicates.min_lines if min_lines is None else min_lines
        groups = clones.clone_groups(self.rows.select("path", "tokens"), m, l, min_occurrences)
        flat = groups.select("fingerprint", "token_count", "line_count", F.posexplode("instances").alias("seq", "i")).select("fingerprint", "token_count", "line_count", "seq", "i.*")
        mk = self.markers.select(F.col("path").alias("mpath"), "level", (F.col("line") + 1).alias("target"), F.explode(F.split("kind", r"[,\s]+")).alias("k"))
        mk = mk.where(scope.plain_kind(F.col("k")).isin("all", "duplicates", *scope.CLONES))
        hit = (F.col("path") == F.col("mpath")) & ((F.col("level") == "file") | F.col("target").between(F.col("start_line"), F.col("end_line")))
        kept = materialize(flat.join(mk, hit, "left_anti"), "clones")
        inst = F.sort_array(F.collect_list(F.struct("seq", F.struct("path", "start_line", "end_line").alias("i"))))
        g = kept.groupBy("fingerprint").agg(F.first("token_count").alias("token_count"), F.first("line_count").alias("line_count"), inst.alias("x"))
        g = g.withColumn("instances", F.transform("x", lambda r: r["i"])).drop("x").where(F.size("instances") >= min_occurrences)
        spans = g.select(F.inline("instances"))
        covered = clones.covered_lines(spans, "path", "start_line", "end_line").agg(F.coalesce(F.sum("duplicated_lines"), F.lit(0)).alias("duplicated_lines"))
        total = self.files.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
        stats = covered.crossJoin(total).crossJoin(g.agg(F.count(F.lit(1)).alias("clone_groups"), F.coalesce(F.sum(F.size("instances")), F.lit(0)).alias("clone_instances"))).withColumn(
            "duplication_percentage", S.rounded(F.col("duplicated_lines") * 100.0 / F.greatest(F.col("total_lines"), F.lit(1)), 2)
        )
        return {"clone_groups": g.orderBy((F.col("token_count") * F.size("instances")).desc(), "fingerprint"), "stats": stats}

    # -- health

    def scored_functions(self) -> DataFrame:
        cov = graph.coverage_labels(self.files.select(F.col("path").alias("node"), "is_test"), self.links)
        f = self.rel("functions").join(cov.withColumnRenamed("node", "path"), "path", "left").fillna(0.0, ["coverage"])
        f = f.withColumn("crap", S.crap(F.col("cyclomatic"), F.col("coverage")))
        return f.withColumn("unit_size_bin", S.size_bin(F.col("lines"))).withColumn("unit_interfacing_bin", S.parameter_bin(F.col("parameters")))

    def health(self, o: HealthOptions | None = None) -> dict:
        o = o or HealthOptions(**vars(self.config.health))
        dead = self.dead_code()
        f = materialize(self.scored_functions(), "functions")
        rules = (
            ("high-cyclomatic-complexity", F.col("cyclomatic") >= o.max_cyclomatic), ("high-cognitive-complexity", F.col("cognitive") >= o.max_cognitive),
            ("high-crap", F.col("crap") >= o.max_crap), ("large-function", F.col("lines") > o.max_unit_size),
        )
        over = f.select("path", "line", "seq", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in rules]))).alias("kind"))
        over = scope.suppressed(over, self.markers).groupBy("path", "seq").agg(F.collect_set("kind").alias("hits"))
        f = f.join(over, ["path", "seq"], "left")
        has = lambda k: F.coalesce(F.array_contains("hits", k), F.lit(False))
        cc, cog, risky = (has(k) for k, _ in rules[:3])
        rule = F.when(cc & cog, "high-complexity").when(cc, rules[0][0]).when(cog, rules[1][0]).otherwise("high-crap")
        findings = f.where(cc | cog | risky).select("path", "name", "line", "lines", "cyclomatic", "cognitive", rule.alias("rule"), S.rounded(F.col("crap"), 2).alias("crap"), "seq")
        per = f.groupBy("path").agg(
            F.sum("cyclomatic").alias("total_cyclomatic"), F.sum("cognitive").alias("total_cognitive"), F.count(F.lit(1)).alias("function_count"),
            F.max("crap").alias("crap_max"), F.count_if(risky).alias("crap_above_threshold"), F.max_by("name", F.struct("cognitive", "seq")).alias("top_name"), F.max("cognitive").alias("top_cognitive"),
        )
        s = per.join(self.files.select("path", "lines"), "path").join(self.fans, "path", "left").join(dead["ratios"].select("path", "exports", "dead_ratio"), "path", "left").fillna(0)
        density = F.col("total_cyclomatic") / F.greatest(F.col("lines"), F.lit(1))
        mi = S.maintainability(density, F.col("dead_ratio"), F.col("fan_out"), F.greatest(F.col("lines"), F.lit(1)))
        s = s.withColumn("maintainability_index", S.rounded(mi, 2)).withColumn("complexity_density", S.rounded(density, 4)).withColumn("crap_max", S.rounded(F.col("crap_max"), 2))
        s = materialize(s.withColumnRenamed("dead_ratio", "dead_code_ratio"), "file-scores")
        out = {
            "file_scores": s.drop("exports", "top_name", "top_cognitive").orderBy(F.greatest(100 - F.col("maintainability_index"), F.col("crap_max")).desc(), "path"),
            "findings": findings.orderBy(F.col("cyclomatic").desc(), "path", "line", "seq").drop("seq"),
            "large_functions": f.where(has("large-function")).select("path", "name", "line", "lines").orderBy(F.col("lines").desc(), "path", "line"),
            "profiles": f.select(F.explode(F.create_map(F.lit("unit_size"), F.col("unit_size_bin"), F.lit("unit_interfacing"), F.col("unit_interfacing_bin"))).alias("profile", "bin"))
            .groupBy("profile", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("profile"))).orderBy("profile", "bin"),
        }
        hot = None
        if o.hotspots:
            now = int(time.time()) if o.now is None else o.now
            ch = C.churn(self.commits.where(F.col("ts") <= now), "path", F.col("ts"), now, o.since_days)
            hot = materialize(C.hotspots(s.select("path", F.col("complexity_density").alias("density"), "fan_in"), ch, o.min_commits), "hotspots")
            out["hotspots"] = hot.orderBy(F.col("score").desc(), "path")
        dup = self.dupes() if o.dupes and (o.score or o.targets) else None
        if o.targets:
            out["targets"] = self._targets(s, f, hot, dead, dup, o.baseline)
        if o.score:
            out["score"] = self._score(s, f, hot, dead, dup)
        return out

    def _targets(self, s, f, hot, dead, dup, baseline) -> DataFrame:
        t = s
        if hot is not None:
            t = t.join(hot.select("path", F.col("score").alias("hotspot"), "trend"), "path", "left")
        else:
            t = t.withColumn("hotspot", F.lit(0.0)).withColumn("trend", F.lit("stable"))
        t = t.fillna({"hotspot": 0.0, "trend": "stable"})
        cyc = dead["circular_dependencies"].select(F.explode("members").alias("path"), "cycle").groupBy("path").agg(F.min("cycle").alias("cycle"))
        entry = dead["entries"].withColumn("is_entry", F.lit(True))
        callers = self.links.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("direct_callers"))
        names = dead["unused_exports"].groupBy("path").agg(F.sort_array(F.collect_list("name")).alias("unused_exports"))
        units = f.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name", "line", "cognitive"))), lambda x: F.struct(x["name"].alias("name"), x["line"].alias("line"), x["cognitive"].alias("cognitive"))).alias("functions"))
        for side in (cyc, entry, callers, names, units):
            t = t.join(side, "path", "left")
        if dup is not None:
            sib = dup["clone_groups"].select("fingerprint", F.explode(F.array_distinct(F.transform("instances", lambda i: i["path"]))).alias("path")).groupBy("path").agg(F.sort_array(F.collect_set("fingerprint")).alias("clone_siblings"))
            t = t.join(sib, "path", "left")
        else:
            t = t.withColumn("clone_siblings", F.lit(None).cast("array<string>"))
        facts = t.withColumn("in_cycle", F.col("cycle").isNotNull()).withColumn("is_entry", F.col("is_entry").isNotNull())
        out = health.targets(facts.select(*health.TARGET_COLUMNS), health.target_limits(s))
        unresolved = self.edges.agg(F.count_if(F.col("to").isNull()).alias("unresolved_imports"))
        evidence = F.struct("functions", "unused_exports", "clone_siblings", F.col("cycle").alias("cycle_path"), "direct_callers", "unresolved_imports").alias("evidence")
        out = out.join(t.select("path", "functions", "unused_exports", "clone_siblings", "cycle", "direct_callers"), "path").crossJoin(F.broadcast(unresolved))  # of one row
        if baseline:
            out = scope.not_listed(out, self.spark.createDataFrame([(k,) for k in baseline], "key string"))
        return health.in_order(out.select("path", "priority", "efficiency", "confidence", "category", "recommendation", "effort", "factors", evidence, "key"))

    def _score(self, s, f, hot, dead, dup) -> DataFrame:
        n_files = self.files.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("files"))
        floor = health.percentiles(self.fans, "fan_in", {"p95": 0.95}).select(F.greatest("p95", F.lit(10)).alias("p95"))
        fans = self.fans.crossJoin(F.broadcast(floor)).agg(F.count_if(F.col("fan_in") > F.col("p95")).alias("high_fan"))  # floor is one row
        fn = f.agg(F.count(F.lit(1)).alias("functions"), F.count_if((F.col("cyclomatic") >= 50) | (F.col("cognitive") >= 30)).alias("critical"), F.count_if(F.col("lines") > 60).alias("over60"))
        sc = s.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("maintainability_index") < 40).alias("low_mi"))
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        parts = [n_files, fans, fn, sc, count(dead["unused_files"], "dead_files"), dead["ratios"].agg(F.coalesce(F.sum("dead"), F.lit(0)).alias("dead_exports"), F.coalesce(F.sum("exports"), F.lit(0)).alias("exports")), count(dead["circular_dependencies"], "loops")]
        parts.append(hot.agg(F.count_if(F.col("score") >= 70).alias("hot")) if hot is not None else self.spark.range(1).select(F.lit(0).alias("hot")))
        parts.append(dup["stats"].select(F.col("duplication_percentage").alias("duplication")) if dup is not None else self.spark.range(1).select(F.lit(0.0).alias("duplication")))
        one = parts[0]
        for p in parts[1:]:
            one = one.crossJoin(p)  # every side is a single row
        return health.score(one)

    # -- inspect, trace

    def target(self, path: str) -> str:
        """A path of the project: exact, else the only one that ends with it."""
        p = path.replace("\\", "/").removeprefix("./")
        if not self.files.where(F.col("path") == p).isEmpty():
            return p
        hit = [r[0] for r in self.files.where(F.col("path").endswith("/" + p)).select("path").orderBy("path").limit(21).collect()]
        if len(hit) != 1:  # (the message names twenty)
            raise ValueError(f"{path}: {'no such file' if not hit else 'ambiguous: ' + ', '.join(hit[:20]) + ' ...' * (len(hit) > 20)}")
        return hit[0]

    def inspect(self, path: str, symbol: str | None = None) -> dict:
        p = self.target(path)
        own = F.col("path") == p
        f = self.rel("functions").where(own)
        if symbol:
            plain, want = F.translate("name", ":", "."), symbol.replace(":", ".")
            hit = f.where((plain == want) | plain.endswith("/" + want) | plain.endswith("." + want))
            if hit.isEmpty() and self.rel("exports").where(own & (F.col("name") == symbol)).isEmpty():
                known = [r[0] for r in f.select("name").orderBy("seq").limit(200).collect()]
                raise ValueError(f"{symbol}: not in {p}; functions: {', '.join(known)}")
            f = hit
        d, h = self.dead_code(), self.health(HealthOptions(**vars(self.config.health), hotspots=False, targets=False, score=False))
        fan = self.fans.where(own).first()
        return {
            "path": p, "symbol": symbol, "fan_in": fan["fan_in"], "fan_out": fan["fan_out"], "functions": f.orderBy("seq"), "exports": self.rel("exports").where(own).orderBy("seq"), "imports": self.links.where(F.col("src") == p).select("dst").orderBy("dst"),
            "importers": self.links.where(F.col("dst") == p).select("src").orderBy("src"), "health": h["file_scores"].where(own), "complexity": h["findings"].where(own),
            "dead_code": d["findings"].where(own), "clones": self.dupes()["clone_groups"].where(F.exists("instances", lambda i: i["path"] == p)),
        }

    def trace(self, path: str, key: str | None = None, depth: int = 3) -> dict:
        p = self.target(path)
        if key is not None and self.rel("exports").where((F.col("path") == p) & (F.col("name") == key)).isEmpty():
            self.inspect(p, key)
        start = self.spark.createDataFrame([(p,)], "node string")
        back = self.links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        out = graph.trace(self.links, start, depth).orderBy("depth", "src", "dst")
        if key is None:
            return {"callees": out, "callers": graph.trace(back, start, depth).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "depth").orderBy("depth", "src", "dst")}
        refs = self.key_refs.where((F.col("to") == p) & (F.col("key") == key))
        first = refs.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.lit(1).alias("depth"), "key", "line")
        users = refs.select(F.col("from").alias("node")).distinct()
        rest = graph.trace(back.where(F.col("src") != p), users, depth - 1).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("depth") + 1).alias("depth"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("line"))
        callers = (first if depth > 0 else first.limit(0)).unionByName(rest)
        return {"callees": out, "callers": callers.orderBy("depth", "src", "dst", "line")}

    # -- audit

    def issues(self) -> DataFrame:
        """(kind, path, name, seq, paths): everything an audit may gate on."""
        d, h = self.dead_code(), self.health(HealthOptions(**vars(self.config.health), hotspots=False, targets=False, score=False))
        one = F.array("path").alias("paths")
        a = d["findings"].where("section <> 'circular_dependencies'").select(F.regexp_replace(F.regexp_replace("section", "ies$", "y"), "s$", "").alias("kind"), "path", "name", F.col("ordinal").alias("seq"), one)
        b = d["circular_dependencies"].select(F.lit("circular_dependency").alias("kind"), "path", "name", F.lit(6).alias("seq"), F.col("members").alias("paths"))
        c = h["findings"].select(F.translate("rule", "-", "_").alias("kind"), "path", "name", F.lit(7).alias("seq"), one)
        paths = F.array_sort(F.array_distinct(F.transform("instances", lambda i: i["path"])))
        g = self.dupes()["clone_groups"].select(F.lit("duplicates").alias("kind"), F.concat_ws(",", paths).alias("path"), F.col("fingerprint").alias("name"), F.lit(8).alias("seq"), paths.alias("paths"))
        return a.unionByName(b).unionByName(c).unionByName(g)

    def audit(self, changed: list[str] | None = None, base: Project | None = None, gate: str = "new-only") -> dict:
        """Issues of changed files; with a base only what it did not have counts, if the gate is new-only."""
        if gate not in ("new-only", "all"):
            raise ValueError(f"unknown gate {gate}")
        i, keys = self.issues(), ["kind", "path", "name"]
        if changed is not None:
            i = scope.touching(i, self.spark.createDataFrame([(p,) for p in changed], "path string"), keys)
        if base is not None and gate == "new-only":
            i = scope.introduced(i, base.issues(), keys, ["seq"])
        else:
            i = i.withColumn("introduced", F.lit(True))
        fails = F.col("kind").isin("unused_file", "boundary_violation") | F.col("kind").contains("complexity") | (F.col("kind") == "high_crap")
        i = materialize(i.withColumn("severity", F.when(fails, 2).otherwise(1)), "issues")
        worst = i.where("introduced").agg(F.coalesce(F.max("severity"), F.lit(0)).alias("w")).first()[0]
        return {"issues": i.orderBy("seq", *keys), "verdict": ("pass", "warn", "fail")[worst], "gate": gate if base is not None else "all"}
