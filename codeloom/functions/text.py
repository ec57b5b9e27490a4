"""Text functions on columns: tokenisers, coverage scores, headers, links, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that symbols can be extracted from, by language.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".py": "python", ".rs": "rust",
    ".go": "go", ".java": "java", ".cs": "csharp", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".swift": "swift",
    ".kt": "kotlin", ".lua": "lua", ".zig": "zig",
}
#: Extensions that only a grammar knows: such files are code, without symbols here.
GRAMMAR_ONLY = ".cjs .cc .php .kts .dart .ex .exs .elm .ml .scala .sc .sol .vue .sh .bash .zsh .toml .yaml .yml .json .html .css .m .re".split()
#: Words before a parenthesis that are no calls.
SKIPPED_CALLS = (
    "if for while switch catch function async return new typeof await console require Object Array String Number Boolean JSON Math Date Promise"
    " Error Map Set setTimeout setInterval parseInt parseFloat isNaN isFinite encodeURIComponent"
).split()
#: What marks a database call, by name and by line.
DB_NAMES = "(?i)^(db|prisma|knex|sequelize|mongoose|supabase|typeorm|drizzle|pool|client|query|execute|findOne|findMany|findAll|findById|save|insert|upsert|count|aggregate|transaction|commit|rollback|connect|disconnect)$"
DB_METHODS = "query execute findOne findMany findAll save insert upsert create update delete remove aggregate transaction collection".split()
DB_WORDS = "prisma knex sequelize mongoose supabase typeorm drizzle".split()
#: Comment markers by language family, for headers.
COMMENT_START = r"^//\s?|^#\s?|^--\s?|^\*\s?|^/\*\*?\s?|\*/$"
#: Routes of a question in order, the first match wins.
ROUTES = (
    ("why.*fail|error|crash", "failure_path"),
    ("call.*chain|trace|flow", "call_chain"),
    ("data.*lineage|transform", "data_lineage"),
    ("depend|impact|blast.*radius", "dependency_impact"),
    ("overview|architecture", "service_overview"),
    ("explain|how.*work|what.*do", "agent"),
)

WORD_BEFORE, WORD_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def whole_word(word: str) -> str:
    """A pattern for a word between ASCII boundaries; Java's own boundary is wider."""
    return f"{WORD_BEFORE}{re.escape(word)}{WORD_AFTER}"


def lines_of(content: Column) -> Column:
    """Lines split at line feeds only; what follows the last one is a line, if empty too."""
    return F.split(content, "\n", -1)


def _cased_apart(text: Column) -> Column:
    apart = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.regexp_replace(apart, "([A-Z])([A-Z][a-z])", "$1 $2"))


def file_terms(text: Column) -> Column:
    """The file search's terms: split at case changes, white space, _ and -; other signs stay."""
    return F.filter(F.split(_cased_apart(text), "[\\s_-]+"), lambda t: F.length(t) > 1)


def identifier_terms(text: Column) -> Column:
    """The identifier search's terms: split at case changes and at all but a-z, 0-9 and _."""
    return F.filter(F.split(_cased_apart(text), "[^a-z0-9_]+"), lambda t: F.length(t) > 1)


def coverage(query: Column, terms: Column) -> Column:
    """The share of distinct query terms among terms; 0 without any."""
    wanted = F.array_distinct(query)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, terms)) / F.size(wanted).cast("double")).otherwise(F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


#: Where the file search splits between two signs of a word: a small letter before a capital one, and
#: a capital one before a capital one that a small one follows.
CASE_CHANGE = "(?:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"


def term_pattern(term: str) -> str:
    """A pattern for a term of a-z and 0-9 among a text's file_terms, without splitting the text."""
    signs = ["[kK\u212a]" if c == "k" else f"[{c}{c.upper()}]" if c.isalpha() else c for c in term]
    return f"(?:^|(?<=[\\s_-])|{CASE_CHANGE}){f'(?!{CASE_CHANGE})'.join(signs)}(?:$|(?=[\\s_-])|{CASE_CHANGE})"


def query_terms(query: str) -> list[str]:
    """file_terms of a query in Python, each once."""
    apart = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", query)).lower()
    return list(dict.fromkeys(t for t in re.split(r"[\s_-]+", apart) if len(t) > 1))


def file_coverage(query: str, text: Column) -> Column:
    """coverage of a query's terms by file_terms(text).  Plain terms are looked for by a pattern each, and
    only where the text contains them at all; other ones need the split text."""
    terms = query_terms(query)
    if not terms or not all(re.fullmatch("[a-z0-9]+", t) for t in terms):
        return coverage(file_terms(F.lit(query)), file_terms(text))
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(t)) & text.rlike(term_pattern(t)), 1).otherwise(0) for t in terms]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return F.when(text.isNotNull(), total / F.lit(float(len(terms))))


def keyword_score(query: str, text: Column, symbols: Column) -> Column:
    """0.65 of the terms covered, 0.20 of those covered by symbols, 0.15 if the query occurs."""
    phrase = F.when(F.contains(F.lower(text), F.lit(query.strip().lower())), 0.15).otherwise(0.0) if query.strip() else F.lit(0.0)
    return clamp(F.lit(0.65) * file_coverage(query, text) + F.lit(0.2) * file_coverage(query, symbols) + phrase)


def combined_score(semantic: Column, keyword: Column, weight: float = 0.72, keyword_weight: float = 0.28) -> Column:
    total = weight + keyword_weight
    return clamp((F.lit(weight) * F.greatest(semantic, F.lit(0.0)) + F.lit(keyword_weight) * keyword) / F.lit(total)) if total > 0 else semantic


def percent(x: Column) -> Column:
    """Rounded half up to a tenth of a percent."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def code_header(content: Column) -> Column:
    """The first two of ten lines that say something once a comment marker is gone, joined."""
    bare = F.transform(F.slice(lines_of(content), 1, 10), lambda x: trimmed(F.regexp_replace(x, COMMENT_START, "")))
    telling = F.filter(bare, lambda x: (x != "") & ~x.startswith("!") & ~x.startswith("use ") & ~x.startswith("import "))
    return F.array_join(F.slice(telling, 1, 2), " | ")


def plain_header(content: Column) -> Column:
    """The first two lines that are not blank, 120 characters of each, joined."""
    bare = F.filter(F.transform(lines_of(content), trimmed), lambda x: x != "")
    return F.array_join(F.transform(F.slice(bare, 1, 2), lambda x: F.substring(x, 1, 120)), " | ")


def line_range(first: Column, last: Column) -> Column:
    return F.when(last > first, F.concat(F.lit("L"), first.cast("string"), F.lit("-L"), last.cast("string"))).otherwise(F.concat(F.lit("L"), first.cast("string")))


def is_definition(line: Column, name: str) -> Column:
    """Whether a line defines a name; a longer name that starts with it counts too."""
    return defines(line, F.lit(re.escape(name)))


def defines(line: Column, word: Column) -> Column:
    """The same for a name that is a column, as a pattern."""
    keywords = (r"(?:function|class|enum|interface|struct|type|trait|fn|def|func)\s+", r"(?:const|let|var|pub|export)\s+(?:async\s+)?(?:function\s+)?")
    first, second = (F.rlike(line, F.concat(F.lit(k), word)) for k in keywords)
    return first | second


def calls_of(line: Column) -> Column:
    """Names called on a line, in order: what stands before a parenthesis, then capital tags."""
    called = F.regexp_extract_all(line, F.lit(r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("), 1)
    tags = F.regexp_extract_all(line, F.lit(r"<([A-Z][a-zA-Z0-9_$]*)"), 1)
    return F.filter(F.concat(called, tags), lambda n: ~n.isin(*SKIPPED_CALLS))


def is_db_line(line: Column) -> Column:
    methods, words = "|".join(DB_METHODS), "|".join(DB_WORDS)
    return line.rlike(rf"{WORD_BEFORE}db\s*[.(]|{WORD_BEFORE}(?:{words}){WORD_AFTER}|\.(?:{methods})\s*\(")


def is_db_name(name: Column) -> Column:
    return name.rlike(DB_NAMES)


def is_test_path(path: Column) -> Column:
    return F.contains(path, F.lit("test")) | F.contains(path, F.lit("spec")) | F.contains(path, F.lit(".demo."))


def wiki_links(content: Column) -> Column:
    """(target, description) of [[target|description]] links in order, cross-links left out."""
    rest = F.regexp_replace(content, r"@linked-to\s+\[\[[^\]]+\]\]", "")
    raw = F.regexp_extract_all(rest, F.lit(r"\[\[([^\]]+)\]\]"), 1)
    bar = lambda x: F.instr(x, "|")
    return F.transform(
        raw,
        lambda x: F.struct(
            trimmed(F.when(bar(x) > 0, F.substring_index(x, "|", 1)).otherwise(x)).alias("target"),
            F.when(bar(x) > 0, trimmed(F.regexp_replace(x, r"^[^|]*\|", ""))).alias("description"),
        ),
    )


def cross_links(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"@linked-to\s+\[\[([^\]]+)\]\]"), 1), trimmed)


def feature_tag(content: Column) -> Column:
    """The first FEATURE comment, null if there is none."""
    return F.nullif(trimmed(F.regexp_extract(content, r"(?m)^(?://|#|--)\s*FEATURE:\s*([^\n]+)", 1)), F.lit(""))


def token_estimate(length: Column) -> Column:
    return F.ceil(length / F.lit(4.0)).cast("long")


def route_question(question: Column) -> Column:
    out = F.lit("direct_graph")
    for pattern, route in reversed(ROUTES):
        out = F.when(F.lower(question).rlike(pattern), route).otherwise(out)
    return out


def repo_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "/"), -1)


def tool_label(name: Column) -> Column:
    """Dashes to spaces and capitals at word starts; the rest stays as it is."""
    words = F.split(F.regexp_replace(name, "-", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def time_ago(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60).cast("long")
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 1, "just now").when(minutes < 60, text(minutes, "m")).when(hours < 24, text(hours, "h")).when(days < 7, text(days, "d")).otherwise(text(F.floor(days / 7), "w"))


#: Icons by what a label says, in order, the first match wins.
ICONS = (
    ("gateway|api.gate", "mdi:gate"), ("lambda|function|serverless", "mdi:lightning-bolt"), ("s3|bucket|storage|blob", "mdi:folder-multiple"),
    ("dynamo|dynamodb|nosql", "mdi:database"), ("rds|postgres|mysql|sql|aurora", "mdi:database"), ("mongo", "mdi:database"),
    ("redis|cache|elasticache", "mdi:cached"), ("queue|sqs|rabbit|kafka", "mdi:tray-full"), ("sns|notification|alert", "mdi:bell"),
    ("cognito|auth|identity|login|sso", "mdi:shield-lock"), ("cloudfront|cdn", "mdi:earth"), ("cloudwatch|monitor|metric|observe", "mdi:monitor-eye"),
    ("ec2|compute|instance|vm", "mdi:server"), ("ecs|container|docker|fargate", "mdi:docker"), ("kubernetes|k8s|eks|aks|gke", "mdi:kubernetes"),
    ("route.?53|dns", "mdi:earth"), ("load.?balancer|elb|alb|nlb", "mdi:scale-balance"), ("kinesis|stream|firehose", "mdi:waves"),
    ("event.?bridge|event", "mdi:lightning-bolt"), ("step.?function|workflow|state.?machine", "mdi:sitemap"),
    ("cloud.?formation|terraform|iac|infra", "mdi:cog"), ("codepipeline|cicd|ci.?cd|pipeline|deploy", "mdi:pipe"), ("codebuild|build|jenkins", "mdi:wrench"),
    ("elastic.?search|opensearch|search", "mdi:magnify"), ("redshift|warehouse|data.?lake", "mdi:database-export"), ("glue|etl|transform", "mdi:swap-horizontal"),
    ("sage.?maker|ml|machine.?learn|model|ai", "mdi:robot"), ("rag|retriev|vector", "mdi:magnify-scan"), ("bedrock|llm|gpt|generat", "mdi:robot"),
    ("rekognition|vision|image", "mdi:eye"), ("transcribe|speech|voice", "mdi:microphone"), ("translate|language", "mdi:translate"),
    ("comprehend|nlp|text.?anal", "mdi:text-recognition"), ("vpc|network|subnet|firewall", "mdi:lan"), ("waf|web.?app.?fire", "mdi:shield"),
    ("secret|vault|ssm|parameter", "mdi:lock"), ("kms|encrypt|key", "mdi:key"), ("cloud.?trail|audit|log", "mdi:file-document-outline"),
    ("x.?ray|trac", "mdi:magnify-scan"), ("iot|sensor|device|thing", "mdi:chip"), ("mqtt|broker|pub.?sub", "mdi:access-point"),
    ("user|client|customer", "mdi:account-group"), ("mobile|ios|android|phone", "mdi:cellphone"), ("web|browser|frontend|app", "mdi:web"),
    ("email|ses|mail", "mdi:email"), ("notification|push", "mdi:bell-ring"), ("chart|dashboard|analytic|report", "mdi:chart-line"),
    ("config|setting", "mdi:cog"), ("bucket|file|object", "mdi:folder"), ("api|rest|endpoint|graphql", "mdi:api"), ("server|host|backend", "mdi:server"),
    ("cloud", "mdi:cloud"), ("database|db|data", "mdi:database"), ("security|protect", "mdi:shield-lock"),
)
DEFAULT_ICON = "mdi:hexagon-outline"
#: Text files that are searched by their first 4000 characters.
TEXT_EXTENSIONS = ".md .txt .json .jsonc .yaml .yml .toml .lock .env".split()


def icon(label: Column) -> Column:
    out, low = F.lit(DEFAULT_ICON), F.lower(label)
    for pattern, name in reversed(ICONS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def navigator_header(content: Column) -> Column:
    """Comment lines among the first five up to the first line of code, joined, 200 characters."""
    start = F.named_struct(F.lit("text"), F.array().cast("array<string>"), F.lit("on"), F.lit(True))

    def step(seen: Column, line: Column) -> Column:
        bare = trimmed(line)
        comment = bare.startswith("//") | bare.startswith("#") | bare.startswith("--")
        more = F.when(seen["on"] & comment, F.concat(seen["text"], F.array(F.regexp_replace(bare, r"^//\s*|^#\s*|^--\s*", "")))).otherwise(seen["text"])
        return F.named_struct(F.lit("text"), more, F.lit("on"), seen["on"] & (comment | (bare == "")))

    return F.substring(F.array_join(F.aggregate(F.slice(lines_of(content), 1, 5), start, step)["text"], " "), 1, 200)


def suffix(path: Column) -> Column:
    """A file's extension as it is written; a name that starts with its only dot has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def is_supported(path: Column) -> Column:
    """Whether a file is code: its extension is that of a language or of a grammar, in any case."""
    return extension(path).isin(*LANGUAGES, *GRAMMAR_ONLY)


def is_text(path: Column) -> Column:
    """Whether a file that is no code is searched as text."""
    return ~is_supported(path) & extension(path).isin(*TEXT_EXTENSIONS)


def search_text(path: Column, content: Column) -> Column:
    """What the file search reads: code whole, other text files' first 4000 characters, else null."""
    return F.when(is_supported(path), content).when(is_text(path), F.substring(content, 1, 4000))


def content_hash(text: Column) -> Column:
    """A signed 32-bit rolling hash: each code unit added to 31 times what was before."""
    units = F.filter(F.split(text, ""), lambda c: c != "")
    whole = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)))
    return F.when(whole >= 1 << 31, whole - (1 << 32)).otherwise(whole)
