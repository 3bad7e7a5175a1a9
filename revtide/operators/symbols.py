"""Symbols that a change defines or touches, and the files that refer to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contamination import staged
from .diffs import changed_text
from .paths import file_name, is_test

#: Fixed file endings of each language, and of header files.
ENDINGS = {
    "python": "py pyi pyx", "typescript": "ts tsx mts cts js jsx mjs cjs", "cpp": "c h cc cpp cxx hh hpp hxx ipp inl cu cuh", "go": "go",
    "jvm": "java kt kts scala cs", "rust": "rs",
}
HEADER_FILE = r"(?i)\.(h|hh|hpp|hxx|cuh|ipp)$"
#: Fixed patterns of what a line of each language defines; the first group is the name. ID is a name with dollar signs.
ID = r"([A-Za-z_$][\w$]*)"
DEFINES = {
    "python": [rf"^\s*(?:async\s+)?def\s+{ID}", rf"^\s*class\s+{ID}", r"^([A-Z][A-Z0-9_]{2,})\s*(?::[^=]*)?="],
    "typescript": [
        rf"\bfunction\s*\*?\s*{ID}", rf"\bclass\s+{ID}", rf"\b(?:interface|type|enum|namespace)\s+{ID}",
        rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:const|let|var)\s+{ID}\s*[=:]",
        rf"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*{ID}\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::\s*[^={{;]+)?\s*\{{",
        rf"^\s*(?:(?:public|private|protected|static|readonly)\s+)*{ID}\s*[=:]\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>",
    ],
    "cpp": [
        r"^\s*#\s*define\s+([A-Za-z_]\w*)", r"\b(?:struct|class|enum(?:\s+class)?|union|namespace|concept)\s+([A-Za-z_]\w*)", r"\busing\s+([A-Za-z_]\w*)\s*=",
        r"\btypedef\b.*?\b([A-Za-z_]\w*)\s*;",
        r"^\s*(?!(?:return|else|new|delete|throw|case|goto|co_return|co_await|co_yield)\b)(?:template\s*<[^>]*>\s*)?(?:[\w:<>,*&~]+\s+)+[*&]*(?:[A-Za-z_]\w*::)*(~?[A-Za-z_]\w*)\s*\(",
    ],
    "go": [rf"^func\s+(?:\([^)]*\)\s*)?{ID}", rf"^type\s+{ID}", rf"^\s*{ID}\s+func\s*\("],
    "jvm": [
        r"\b(?:class|interface|enum|record|struct|object|trait)\s+([A-Za-z_]\w*)",
        r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|override|virtual|async|open|suspend|fun)\s+)+(?:[\w<>\[\],.?]+\s+)?([A-Za-z_]\w*)\s*\(",
    ],
    "rust": [r"\bfn\s+([A-Za-z_]\w*)", r"\b(?:struct|enum|trait|type|mod|union)\s+([A-Za-z_]\w*)", r"\bmacro_rules!\s*([A-Za-z_]\w*)"],
}
ANY_LANGUAGE = [rf"\b(?:def|function|func|fn|class|struct|interface|enum|type)\s+{ID}"]
CALLED = r"([A-Za-z_]\w*)\s*\("
#: Fixed names that tell nothing: keywords, hooks and common verbs; and file names that tell nothing of a module.
COMMON_NAMES = (
    "if else for while do switch case catch try return new delete sizeof typeof instanceof await yield async const let var void int char bool float double "
    "long short unsigned signed auto static inline extern struct class enum union namespace template typename public private protected virtual override final "
    "operator this self cls super none null true false undefined function def fn func main init __init__ __call__ __repr__ __str__ __eq__ __hash__ constructor "
    "destructor render setup teardown get set run test tests call apply update create build make handle process start stop close open read write reset clear "
    "value values data name type key keys id index item items list dict map string number object props state config options args kwargs result error err ctx "
    "context default exports module require include import from export describe it expect assert then"
).split()
COMMON_MODULES = "index utils util types type main __init__ common base constants helpers mod lib test tests conftest".split()
#: The most telling kind comes first.
KINDS = ["definition", "header", "module", "hunk_context"]


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for language, endings in reversed(ENDINGS.items()):
        out = F.when(path.rlike(rf"(?i)\.({endings.replace(' ', '|')})$"), language).otherwise(out)
    return out


def defined(line: Column, language: Column) -> Column:
    """The names that a line defines, of the patterns of its language or of any."""
    names = lambda patterns: F.flatten(F.array(*(F.regexp_extract_all(line, F.lit(f"(?U){p}"), F.lit(1)) for p in patterns)))
    out = names(ANY_LANGUAGE)
    for name, patterns in DEFINES.items():
        out = F.when(language == name, names(patterns)).otherwise(out)
    return out


def usable(name: Column) -> Column:
    return (F.length(name) >= 3) & ~F.lower(name).isin(COMMON_NAMES) & ~name.rlike(r"(?U)^\d+$")


def changed_symbols(files: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """(keys, name, kind, source, rank): the `limit` most telling symbols of a change, which is the feature.

    files (keys, path, patch): names defined on changed lines and in hunk headers, a header file's name, a module's name.
    Tests define nothing here. A name that is found as several kinds is the most telling of them, then of the first path;
    kinds go in the order of KINDS, longer names first inside a kind.
    """
    rows = files.filter(~is_test(F.col("path"))).select(*keys, "path", language_of(F.col("path")).alias("_language"), F.col("patch"))
    hunks = rows.select(*keys, "path", "_language", F.explode(changed_text("patch")).alias("_h"))
    of = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    section = F.when(F.col("_h.section") != "", F.array(of("hunk_context", F.col("_h.section")))).otherwise(F.array())
    told = hunks.select(*keys, "path", "_language", F.explode(F.concat(F.transform("_h.lines", lambda x: of("definition", x)), section)).alias("x"))
    told = told.select(*keys, "path", "x.kind", "x.text", defined(F.col("x.text"), F.col("_language")).alias("_named"))
    called = F.slice(F.regexp_extract_all("text", F.lit(f"(?U){CALLED}"), F.lit(1)), 1, 1)
    names = F.when((F.col("kind") == "definition") | (F.size("_named") > 0), F.col("_named")).otherwise(called)
    in_text = told.select(*keys, "path", "kind", F.explode(names).alias("name"))
    base = file_name(F.col("path"))
    module = F.substring_index(base, ".", 1)
    fine = F.col("_language").isNotNull() & usable(module) & ~F.regexp_replace(F.lower(module), "^_+", "").isin(COMMON_MODULES)
    header = base.rlike(HEADER_FILE)
    of_path = rows.select(
        *keys, "path", F.when(header, "header").otherwise("module").alias("kind"), F.when(header, base).when(fine, module).alias("name"), header.alias("_header")
    ).filter("name IS NOT NULL")
    found = in_text.filter(usable(F.col("name"))).unionByName(of_path.drop("_header"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    best = found.groupBy(*keys, "name").agg(F.min(F.struct(order.alias("order"), F.col("path"), F.col("kind"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("b.order", F.desc(F.length("name")), "name"))
    return best.select(*keys, "name", F.col("b.kind").alias("kind"), F.col("b.path").alias("source"), rank.alias("rank")).filter(F.col("rank") <= limit)


#: So many distinct words of symbols are broadcast to prune the files' words; more are joined.
BROADCAST_WORDS = 200_000


def references(symbols: DataFrame, files: DataFrame, changed: DataFrame, keys: list[str], most_files: int) -> tuple[DataFrame, DataFrame]:
    """Files that mention a symbol as a whole word: (keys, path, hits, names), and the symbols dropped: (keys, name, files).

    symbols (keys, name), files (keys, path, text), changed (keys, path). Changed files and those of no known language
    don't count. A symbol that more than most_files files mention is dropped. An inverted index finds the candidates:
    each file's distinct words meet the first word of each symbol; names of several words are then looked for whole.
    Symbols, words that meet one and mentions are staged, as several parts read each of them.
    """
    word = F.regexp_extract("name", r"(?U)(\w+)", 1)
    asked = staged(symbols.select(*keys, "name").distinct().withColumn("_word", word).filter("_word <> ''"))
    others = files.filter(language_of(F.col("path")).isNotNull()).join(changed.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")
    known = asked.select("_word").distinct()
    words = others.select(*keys, "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("_word"))
    if known.count() <= BROADCAST_WORDS:
        words = words.join(F.broadcast(known), "_word", "left_semi")
    met = staged(words.join(asked, [*keys, "_word"]))
    whole = met.filter("name = _word").select(*keys, "path", "name")
    # a name of several words: its place in the text decides
    parts = met.filter("name <> _word").join(others, [*keys, "path"])
    beside = F.concat(F.lit(r"(?U)(?<!\w)\Q"), "name", F.lit(r"\E(?!\w)"))
    found = staged(whole.unionByName(parts.filter(F.rlike("text", beside)).select(*keys, "path", "name")))
    counts = found.groupBy(*keys, "name").agg(F.count("*").alias("files"))
    kept = found.join(counts.filter(F.col("files") <= most_files).drop("files"), [*keys, "name"])
    hits = kept.groupBy(*keys, "path").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list("name")).alias("names"))
    return hits, counts.filter(F.col("files") > most_files)
