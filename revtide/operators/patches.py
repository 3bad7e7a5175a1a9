"""Files of a git diff, and declarative checks over the lines that a patch adds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import once
from ..functions.texts import LINE_END, OTHER_END, stripped
from .diffs import added_lines
from .paths import in_scope

#: Fixed first line of a file in a git diff.
GIT_FILE = r"diff --git a/([^\n]+?) b/([^\n]+)"
#: Fixed lines of its header, by the name of what they tell.
HEADER = {
    "from": r"(?dm)^rename from ([^\n]*)$", "to": r"(?dm)^rename to ([^\n]*)$", "new": r"(?dm)^\+\+\+ ([^\n]*)$", "old": r"(?dm)^--- ([^\n]*)$",
    "status": r"(?dm)^(new file mode|deleted file mode|rename from )",
}


def last(text: Column, pattern: str) -> Column:
    """The first group of the last match, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each worked out once a row however often and in however many filters later steps read it."""
    one = rows.select("*", F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_once"))
    return one.select(*rows.columns, "_once.*")


def split_diff(diffs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, ord, path, status, patch, previous_path): one row per file of a unified diff.

    A file starts at a `diff --git` line; before the first of those, a plain `---` line starts one. Its hunks start at
    its first `@@`; hunk is null if it has none (binary files, pure renames). previous_path is null unless it differs.
    A null text has no files.
    """
    whole = F.when(F.col(text).rlike(OTHER_END), F.regexp_replace(F.col(text), LINE_END, "\n")).otherwise(F.col(text))
    cut = F.split(whole, rf"(?dm)^(?={GIT_FILE}$)")
    rows = worked_out(diffs.select(*keys, F.posexplode(cut).alias("ord", "_file")), _git=F.col("_file").rlike(rf"^{GIT_FILE}(\n|\z)"))
    plain = F.regexp_extract("_file", r"(?dms)^(--- .*)", 1)  # what follows the first such line
    rows = worked_out(rows, _part=F.when(F.col("_git"), F.col("_file")).otherwise(plain)).drop("_file")
    rows = worked_out(rows, _at=F.regexp_instr("_part", F.lit(r"(?dm)^@@")))
    hunks_at, part = F.col("_at") > 0, F.col("_part")
    body = F.substring(part, F.col("_at"), F.length(part))
    lines = F.array_join(F.filter(F.split(body, "\n"), lambda line: line.startswith("@@") | line.rlike(r"^[ +\-\\]")), "\n")
    rows = worked_out(rows, _head=F.when(hunks_at, F.substring(part, F.lit(1), F.col("_at") - 1)).otherwise(part), _hunks=F.when(hunks_at, lines)).drop("_part", "_at")
    head, git = F.col("_head"), F.col("_git")
    rows = worked_out(
        rows, **{f"_{name}": last(head, pattern) for name, pattern in HEADER.items()},
        _a=F.when(git, F.regexp_extract(head, f"^{GIT_FILE}", 1)), _b=F.when(git, F.regexp_extract(head, f"^{GIT_FILE}", 2)),
    ).drop("_head")
    rows = worked_out(rows, _minus=stripped(F.col("_old")), _plus=stripped(F.col("_new")))
    bare = lambda c, prefix: F.when(c.startswith(f"{prefix}/"), F.substring(c, 3, 2**31 - 1)).otherwise(c)
    before = F.when(git, F.coalesce("_from", "_a")).otherwise(bare(F.col("_minus"), "a"))
    gone, mode = F.col("_plus") == "/dev/null", F.col("_status")
    path = F.when(gone & (before != ""), before).when(F.col("_plus").isNotNull() & ~gone, bare(F.col("_plus"), "b")).otherwise(F.coalesce("_to", "_b"))
    status = (
        F.when(gone & (before != ""), "removed").when(git & (F.col("_minus") == "/dev/null"), "added").when(mode == "new file mode", "added")
        .when(mode == "deleted file mode", "removed").when(mode.isNotNull(), "renamed").otherwise("modified")
    )
    named = worked_out(rows, path=path, status=status, _before=before).filter("path IS NOT NULL")
    patch = F.when(F.col("_hunks") != "", F.col("_hunks")).alias("patch")
    return named.select(*keys, "ord", "path", "status", patch, F.when(F.col("_before") != F.col("path"), F.col("_before")).alias("previous_path"))


REGEX, STRUCTURAL, THRESHOLD = "added_lines_regex", "structural_pattern", "threshold"


@dataclass(frozen=True)
class Check:
    """A rule as data. Patterns are Java regular expressions and are searched for, not matched whole."""

    rule: str
    engine: str
    pattern: str = ""
    exclude: str | None = None
    select: str = ""
    threshold: int = 0
    languages: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    severity: str = "nit"
    category: str = "style"


def hit(check: Check, added: Column, before: Column, after: Column) -> Column:
    """struct(rule, severity, category, line, detail) of where a check fires in a file, or null. added: struct(line, text) of every added line."""
    fired = lambda line, detail: F.struct(*(F.lit(x).alias(name) for name, x in (("rule", check.rule), ("severity", check.severity), ("category", check.category))), line.alias("line"), detail.alias("detail"))
    if check.engine == THRESHOLD:
        crossed = (F.coalesce(before, F.lit(0)) < check.threshold) & (after >= check.threshold)
        beyond = F.get(F.filter(added, lambda x: x["line"] >= check.threshold), 0)["line"]
        line = F.coalesce(beyond, F.get(added, F.size(added) - 1)["line"], after)
        return F.when(crossed, fired(line, F.format_string("(%d lines before this change, %d after.)", F.coalesce(before, F.lit(0)), after)))
    matches = lambda text: text.rlike(check.pattern if check.engine == REGEX else check.select)
    lines = F.filter(added, lambda x: ~x["text"].rlike(check.exclude) & matches(x["text"]) if check.exclude else matches(x["text"]))

    def told(found: Column) -> Column:
        one = F.get(found, 0)
        if check.engine == REGEX:
            more = F.when(F.size(found) > 1, F.concat(F.lit(" and "), F.size(found) - 1, F.lit(" more added lines"))).otherwise("")
            text = F.substring(stripped(one["text"]), 1, 120)
            return F.when(F.size(found) > 0, fired(one["line"], F.concat(F.lit("(Line "), one["line"], F.lit(": `"), text, F.lit("`"), more, F.lit(".)"))))
        every = (F.size(found) > 0) & F.forall(found, lambda x: x["text"].rlike(check.pattern))
        return F.when(every, fired(one["line"], F.format_string("(%d added assertion lines, first at line %d.)", F.size(found), one["line"])))

    return once(lines, told)


def run_checks(files: DataFrame, checks: list[Check], keys: list[str]) -> DataFrame:
    """(keys, path, rule, severity, category, line, detail): a row for each file and check that fires there.

    files (keys, path, status, language, patch, before, after): lines of the file before and after, null where it isn't
    there. Removed files, and those out of a check's languages and paths, are left alone. All checks see a file's added
    lines in one pass.
    """
    rows = files.filter(~F.col("status").eqNullSafe("removed")).withColumn("_added", added_lines("patch"))
    found = []
    for check in checks:
        mine = in_scope(F.col("path"), list(check.paths)) & (F.col("language").isin(*check.languages) if check.languages else F.lit(True))
        found.append(F.when(mine, hit(check, F.col("_added"), F.col("before"), F.col("after"))))
    fired = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select(*keys, "path", F.explode(fired).alias("_f")).select(*keys, "path", "_f.*")
