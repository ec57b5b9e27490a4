"""One method for each tool over a source tree; each returns a DataFrame, the *_text ones a rendering."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chains, clustering, code, hubs, providers, search, tree
from codeloom.operators.restore import RestorePoints
from codeloom.operators.symbols import extract_symbols
from codeloom.sources import config, repo

#: Syntax checkers by extension.
CHECKERS = {".py": ["python", "-m", "py_compile"], ".ts": ["npx", "tsc", "--noEmit"], ".rs": ["cargo", "check"], ".go": ["go", "vet", "./..."]}


#: What a skeleton says of files without symbols.
UNSUPPORTED, NO_SYMBOLS = "[Unsupported language, showing first 20 lines]", "[No symbols detected, showing first 30 lines]"
#: What a file search says.
NOTHING_FOUND, RESULTS = "No matching files found for the given query.", 'Top {n} hybrid matches for: "{query}"'


class Engine:
    """Tables of a tree are read once and cached until ``refresh``."""

    def __init__(self, spark: SparkSession, root: str, provider: Callable[[list[str]], list[list[float]]] = providers.hashed_vectors):
        self.spark, self.root, self.provider = spark, root, provider

    @cached_property
    def files(self) -> DataFrame:
        return repo.files(self.spark, self.root).cache()

    @cached_property
    def lines(self) -> DataFrame:
        return repo.lines(self.files).cache()

    @cached_property
    def symbols(self) -> DataFrame:
        supported = F.concat(F.lit("."), F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))).isin(*T.LANGUAGES)
        return extract_symbols(self.files.filter(supported)).cache()

    def refresh(self) -> None:
        for name in ("files", "lines", "symbols", "_documents", "_vectors", "_identifiers"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    def context_tree(self, target: str = "", depth_limit: int = 0, max_tokens: int = 20000, include_symbols: bool = True) -> DataFrame:
        """The tree as rows, at the richest level of detail that fits; see tree.context_tree."""
        entries = repo.entries(self.spark, self.root, target, depth_limit).select(F.col("relative_path").alias("path"), "depth", "is_directory")
        code_files = self.files.filter(T.is_supported(F.col("relative_path")))
        headers = code_files.select(F.col("relative_path").alias("path"), T.code_header(F.col("content")).alias("header"))
        shown = self.symbols if include_symbols else self.symbols.limit(0)
        return tree.context_tree(entries, headers, tree.symbol_lines(shown), max_tokens)

    def context_tree_text(self, target: str = "", depth_limit: int = 0, max_tokens: int = 20000, include_symbols: bool = True) -> str:
        return tree.rendered(self.context_tree(target, depth_limit, max_tokens, include_symbols), max_tokens)

    def file_skeleton_text(self, path: str) -> str:
        """A file's header, symbols and their members by signature; without any the first lines."""
        one = self.files.filter(F.col("relative_path") == path)
        known = one.select(T.is_supported(F.col("relative_path")).alias("code"), T.code_header(F.col("content")).alias("header"), F.size(T.lines_of(F.col("content"))).alias("n"), F.slice(T.lines_of(F.col("content")), 1, 30).alias("first")).first()
        first = known.first if known else []
        if known is None or not known.code:
            return UNSUPPORTED + "\n\n" + "\n".join(first[:20])
        found = self.symbols.filter(F.col("file") == path).orderBy("ordinal").collect()
        if not found:
            return NO_SYMBOLS + "\n\n" + "\n".join(first)
        tops = [s for s in found if not s.parent_name]
        out = [f"File: {path} ({known.n} lines)", f"Symbols: {len(tops)} top-level definitions", ""]
        out += [f"// {known.header}", ""] if known.header else []
        for i, s in enumerate(found):
            out.append(("  " if s.parent_name else "") + f"[{s.kind}] {chains.span(s)} {s.signature};")
            if s.parent_name and (i + 1 == len(found) or not found[i + 1].parent_name):
                out.append("")  # after the members of one
        return "\n".join(out)

    def blast_radius(self, symbol: str, context: str | None = None) -> DataFrame:
        return code.usages(self.lines, symbol, context)

    @cached_property
    def _documents(self) -> DataFrame:
        return search.search_documents(self.files, self.symbols).cache()

    @cached_property
    def _vectors(self) -> DataFrame:
        return providers.embed_rows(self._documents.select(F.col("id").alias("key"), F.col("embedded").alias("text")), provider=self.provider).cache()

    def semantic_code_search(self, query: str, k: int = 5, **options: float) -> DataFrame:
        """Files ranked by meaning and keywords, with the symbols that match and their places; options as
        in config.search_options."""
        docs = self._documents.join(self._vectors.withColumnRenamed("key", "id"), "id").select("id", self._documents["text"], "symbols", "v")
        found = search.hybrid_search(docs, query, search.query_vector(self.provider([query])[0]), **config.search_options(k, **options), ranked=True)
        matched = self._documents.select("id", "header", search.matched_symbols(query, F.col("entries")).alias("matched"))
        places = F.transform("matched", lambda e: F.concat(e["name"], F.lit("@"), T.line_range(e["line"], e["end_line"])))
        return found.join(matched, "id").withColumns({"matched_symbols": F.col("matched.name"), "matched_locations": places}).drop("matched").orderBy("rank")

    def semantic_code_search_text(self, query: str, k: int = 5, **options: float) -> str:
        rows = self.semantic_code_search(query, k, **options).collect()
        if not rows:
            return NOTHING_FOUND
        out = [RESULTS.format(n=len(rows), query=query), ""]
        for i, r in enumerate(rows, 1):
            out += [f"{i}. {r.id} ({r.score:g}% total)", f"   Semantic: {r.semantic_score:g}% | Keyword: {r.keyword_score:g}%"]
            out += [f"   Header: {r.header}"] if r.header else []
            out += [f"   Matched symbols: {', '.join(r.matched_symbols)}", f"   Definition lines: {', '.join(r.matched_locations)}"] if r.matched_symbols else []
            out.append("")
        return "\n".join(out)

    @cached_property
    def _identifiers(self) -> DataFrame:
        """Each symbol with what is matched and what is embedded of it."""
        headers = self.files.select(F.col("relative_path").alias("file"), T.code_header(F.col("content")).alias("header"))
        rows = self.symbols.join(headers, "file", "left").select("*", F.concat_ws(":", "file", "name", F.col("line").cast("string")).alias("id"))
        embedded = F.concat_ws(" ", "name", "kind", "signature", "file", F.coalesce("header", F.lit("")), F.coalesce("parent_name", F.lit("")))
        vectors = providers.embed_rows(rows.select(F.col("id").alias("key"), embedded.alias("text")), provider=self.provider)
        held = rows.withColumn("text", F.concat_ws(" ", "name", "signature", "file", F.coalesce("header", F.lit(""))))
        return held.join(vectors, F.col("id") == F.col("key")).drop("key").cache()

    def semantic_identifier_search(self, query: str, k: int = 5, kinds: list[str] | None = None, semantic_weight: float | None = None, keyword_weight: float | None = None) -> DataFrame:
        """Symbols ranked by meaning and keywords, with their place."""
        weights = config.weight(semantic_weight, 0.78), config.weight(keyword_weight, 0.22)
        found = search.identifier_search(self._identifiers, query, search.query_vector(self.provider([query])[0]), kinds, config.top_k(k, 5), *weights)
        places = self._identifiers.select("id", "kind", "file", "line", "end_line", "signature", "parent_name")
        return found.join(places, "id").orderBy("rank")

    def identifier_calls(self, query: str, k: int = 5, kinds: list[str] | None = None, calls: int = 10) -> DataFrame:
        """Where the symbols that a search finds are used, ranked; see search.identifier_calls."""
        top = self.semantic_identifier_search(query, k, kinds)
        return search.identifier_calls(self.lines, top, query, search.query_vector(self.provider([query])[0]), config.top_k(calls, 10), self.provider).orderBy("id", "rank")

    def identifier_search_text(self, query: str, k: int = 5, kinds: list[str] | None = None, calls: int = 10) -> str:
        found = self.semantic_identifier_search(query, k, kinds).collect()
        if not found:
            return "No identifiers matched."
        used: dict[str, list] = {}
        for site in self.identifier_calls(query, k, kinds, calls).collect():
            used.setdefault(site.id, []).append(site)
        out = [f'Top {len(found)} identifier matches for: "{query}"', ""]
        for i, s in enumerate(found, 1):
            out += [f"{i}. {s.kind} {s.name} - {s.file} ({chains.span(s)})", f"   Score: {s.score:g}% | Semantic: {s.semantic_score:g}% | Keyword: {s.keyword_score:g}%", f"   Signature: {s.signature}"]
            out += [f"   Parent: {s.parent_name}"] if s.parent_name else []
            sites = used.get(s.id, [])
            out.append(f"   Calls ({len(sites)}/{sites[0].total}):" if sites else "   Calls: none found")
            out += [f"     {c.rank}. {c.file}:L{c.line} ({c.score:g}%) {c.context}" for c in sites] + [""]
        return "\n".join(out)

    def call_edges(self) -> DataFrame:
        """Calls of each symbol in order, with the best definition of their name; see chains.call_edges."""
        return chains.call_edges(chains.bodies(self.symbols, self.files))

    def call_chain(self, symbol: str, file_path: str | None = None, max_depth: int = 6, marks: list[str] | None = None) -> DataFrame:
        """The tree of calls below a symbol, in order; see chains.call_chains.  LookupError if the symbol is
        unknown, or defined in several places and no file is given."""
        found = chains.starts(self.symbols, symbol, file_path)
        if not found:
            raise LookupError(chains.NOT_FOUND.format(name=symbol))
        if len(found) > 1:
            every = self.symbols.filter(F.col("name") == symbol).orderBy("file", "line").collect()
            places = [f"  {s.file}  L{s.line}  ({s.kind})" for s in every]
            raise LookupError("\n".join([chains.SEVERAL.format(name=symbol, n=len(every)), *places]))
        held = chains.bodies(self.symbols, self.files, marks)
        root = held.filter((F.col("file") == found[0].file) & (F.col("line") == found[0].line)).select("key")
        return chains.call_chains(held, root, max_depth).orderBy("path")

    def call_chain_text(self, symbol: str, file_path: str | None = None, max_depth: int = 6, marks: list[str] | None = None) -> str:
        try:
            chain = self.call_chain(symbol, file_path, max_depth, marks).cache()
        except LookupError as error:
            return str(error)
        rows, n = chain.collect(), chains.chain_stats(chain).first()
        chain.unpersist()
        head = [chains.TITLE.format(name=symbol, depth=max_depth), f"{rows[0].file}  {chains.span(rows[0])}", f"Signature: {rows[0].signature}", ""]
        return "\n".join([*head, chains.render_chain(rows), chains.COUNTS.format(**n.asDict())])

    def semantic_navigate(self, max_depth: int = 3, leaf: int = 20, most: int = 20) -> DataFrame:
        """(cluster_path, file): files split by meaning until a part has ``leaf`` of them at most."""
        level = self._vectors.select(F.lit("").alias("part"), F.col("key").alias("id"), "v")
        done = None
        for _ in range(max_depth):
            sizes = level.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
            small = level.join(sizes.filter(F.col("n") <= leaf), "part", "left_semi").select("part", "id")
            done = small if done is None else done.unionByName(small)
            large = level.join(sizes.filter(F.col("n") > leaf), "part", "left_semi")
            labels = clustering.spectral_clusters(large, ["part"], most)
            level = labels.join(large.select("id", "v"), "id").select(F.concat_ws("/", "part", F.col("cluster").cast("string")).alias("part"), "id", "v")
        return done.unionByName(level.select("part", "id")).select(F.col("part").alias("cluster_path"), F.col("id").alias("file"))

    def navigate_text(self, ask: Callable[[str], str], max_depth: int = 3, leaf: int = 20, most: int = 20) -> str:
        """The tree of semantic_navigate with siblings named by a model; its rows come to the driver."""
        headers = self.files.select(F.col("relative_path").alias("file"), T.navigator_header(F.col("content")).alias("header"))
        rows = [(r.cluster_path.split("/")[1:], r.file, r.header or "") for r in self.semantic_navigate(max_depth, leaf, most).join(headers, "file").orderBy("cluster_path", "file").collect()]

        def render(held: list, depth: int) -> list[str]:
            parts: dict[str, list] = {}
            for row in held:
                parts.setdefault(row[0][depth] if len(row[0]) > depth else "", []).append(row)
            if set(parts) <= {""}:
                return ["  " * depth + f"  {file}" + (f" - {header}" if header else "") for _, file, header in held]
            siblings = [([(file, header) for _, file, header in part], clustering.path_pattern([file for _, file, _ in part])) for part in parts.values()]
            labels = clustering.label_siblings(siblings, ask)
            return [line for label, part in zip(labels, parts.values(), strict=True) for line in ["  " * (depth + 1) + f"[{label}]", *render(part, depth + 1)]]

        return "\n".join(render(rows, 0))

    def feature_hubs(self) -> DataFrame:
        return hubs.hubs_of(self.files)

    def orphans(self) -> DataFrame:
        return hubs.orphans(self.files, self.feature_hubs())

    def feature_hub_text(self, path: str | None = None, name: str | None = None, orphans: bool = False) -> str:
        """A hub by path or name with the skeletons of the files that it links, the list of hubs, or the orphans."""
        all_hubs = self.feature_hubs()
        if orphans:
            found = [r.relative_path for r in self.orphans().collect()]
            if not found:
                return "No orphaned files. All source files are linked to a hub."
            return "\n".join([f"Orphaned Files ({len(found)}):", *(f"  {x}" for x in found)])
        if path is None and name is None:
            counts = hubs.hub_links(all_hubs).groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
            listed = all_hubs.select("hub", "title").join(counts, "hub", "left").orderBy("hub").collect()
            return "\n".join([f"Feature Hubs ({len(listed)}):", "", *(f"  {h.hub} | {h.title} | {h.n or 0} links" for h in listed)]) if listed else "No hub files found."
        hub = (hubs.find_hub(all_hubs, name) if path is None else all_hubs.filter(F.col("hub") == path)).first()
        if hub is None:
            return f"Hub file not found: {path}" if path else "\n".join([f'No hub found for feature "{name}". Available hubs:', *(f"  - {h.hub}" for h in all_hubs.select("hub").collect())])
        one = all_hubs.filter(F.col("hub") == hub.hub)
        links = hubs.resolved(hubs.hub_links(one), self.files).orderBy("ordinal").collect()
        crossed = [r.hub_name for r in hubs.cross_links(one).collect()]
        out = [f"Hub: {hub.title}", f"Path: {hub.hub}", f"Links: {len(links)}", *([f"Cross-links: {', '.join(crossed)}"] if crossed else []), "", "---", ""]
        for link in links:
            if link.found:
                out += [f"## {link.target}" + (f" - {link.description}" if link.description else ""), self.file_skeleton_text(link.target), ""]
        missing = [link.target for link in links if not link.found]
        return "\n".join(out + (["---", f"Missing Links ({len(missing)}):", *(f"  {x}" for x in missing)] if missing else []))

    def static_analysis(self, target: str) -> tuple[int, str]:
        """Runs the checker of a file's language with arguments in a list, never through a shell."""
        command = CHECKERS.get(os.path.splitext(target)[1])
        if command is None:
            return 0, "No checker"
        args = command + ([os.path.join(self.root, target)] if target.endswith(".py") else [])
        try:
            ran = subprocess.run(args, cwd=self.root, capture_output=True, text=True, timeout=30, check=False)
        except (OSError, subprocess.TimeoutExpired) as error:
            return 1, str(error)
        return ran.returncode, (ran.stdout + ran.stderr)[:5000]

    def propose_commit(self, path: str, content: str) -> DataFrame:
        """Broken rules of a new content.  Unless more than 5 comments reject it, a restore point is made
        and the file written."""
        full = os.path.realpath(os.path.join(self.root, path))
        if not full.startswith(os.path.realpath(self.root) + os.sep):
            raise ValueError(f"{path} is outside the tree")
        rows = [(path, i, x) for i, x in enumerate(content.split("\n"), 1)]
        broken = code.violations(self.spark.createDataFrame(rows, "file string, line long, text string"))
        if broken.filter("rejects").isEmpty():
            RestorePoints(self.spark, self.root).create([path], f"Before commit to {path}")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(content)
            self.refresh()
        return broken

    def register_views(self, prefix: str = "") -> list[str]:
        """Temporary views of the tree for SQL; vectors are made when that view is first read."""
        tables = {
            "files": self.files,
            "lines": self.lines,
            "symbols": self.symbols,
            "calls": self.call_edges(),
            "vectors": self._vectors,
            "hub_links": self.feature_hubs(),
            "restore_points": self.list_restore_points(),
        }
        for name, table in tables.items():
            table.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in tables]

    def undo_change(self, point: str) -> list[str]:
        restored = RestorePoints(self.spark, self.root).restore(point)
        self.refresh()
        return restored

    def list_restore_points(self) -> DataFrame:
        return RestorePoints(self.spark, self.root).points()

    def ask_question(self, question: str, chat: Callable[[list[dict], bool], dict]) -> str:
        """An agent's answer, with this engine's tools."""
        table = lambda df: df.limit(50).toPandas().to_string()
        tools = {
            "semantic_code_search": lambda query, k=5: table(self.semantic_code_search(query, k)),
            "get_call_chain": lambda symbol, file_path=None: self.call_chain_text(symbol, file_path),
            "get_blast_radius": lambda symbol: table(self.blast_radius(symbol)),
            "get_context_tree": lambda: self.context_tree_text(),
            "get_file_skeleton": lambda path: self.file_skeleton_text(path),
        }
        return providers.Agent(chat, tools).ask(question)
