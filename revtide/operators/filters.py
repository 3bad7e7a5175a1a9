"""Accounts and pull requests: kinds, exclusions, branch copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of automation accounts, coding agents and AI reviewers, accounts that look like bots, repos whose AI
#: reviews come from the account of their actions, and repos that land pull requests by a commit.
BOT_LOGIN = (
    r"(?i)(\[bot\]$|bot$|-robot$|^robot-|^bors$|^homu$|^rustbot$|^codecov|^netlify|^vercel$|^miss-islington$|^trop$"
    r"|machine$|autoroll|-automation$|-builds?$|-publish$|^publish-|-devprod$|-service$|-integration$|wpt-sync"
    r"|^azure-sdk$|^hc-github-team-|^consvc$|^weblate$|-teamcity$)"
)
AGENT_LOGIN = (
    r"(?i)^(copilot-swe-agent|copilot|claude|cursor|devin-ai-integration|chatgpt-codex-connector|codex|google-labs-jules"
    r"|openhands(-agent)?|sweep-ai|agent-sandbox-\S+|robobun|groeneai|clickgapai|astrobot-houston|netzenbot|divybot"
    r"|crowlbot|nathanwhitbot|zaniebot)$"
)
AI_LOGIN = (
    r"(?i)(copilot|coderabbit|gemini|greptile|sourcery|codex|claude|cursor|qodo|ellipsis|graphite|korbit|cubic|bito|devin"
    r"|augment|bonk|macroscope|depthfirst|review-bot|cat-bot|^clickhouse-gh$|^vercel$|^sentry$)"
)
HUMAN_LOGIN = ("paleolimbot",)
ACTIONS_LOGIN, AI_BY_ACTIONS = "github-actions", ("systemd/systemd", "elastic/kibana", "apache/doris", "dotnet/runtime")
LANDED_BY_COMMIT = ("curl/curl", "vim/vim")
#: Fixed patterns of titles left out: backports and release branches, release ceremony, merges of branches, automation.
EXCLUDED_TITLE = (
    r"(?i)(^(rollup of|automated cherry pick|\[automated\]|bump |chore\(deps|update dependency|\[bot\])"
    r"|^(\s*\[[^\]]*\])*\s*\[[^\]]*(\d+\.(\d+|x)|release|backport)[^\]]*\]"
    r"|^\s*\[(cp-[^\]]*|stable|beta|lts|v\d+-\d+(-\w+)?)\]"
    r"|^(branch|release)-\d+(\.\d+)*\s*:"
    r"|\(uplift to [^)]*\)|\bstable batch\b"
    r"|\b(backport|cherry[- ]?pick)\b|🍒"
    r"|^(chore\((release|merge-back)\): *v?\d|\[ci\] (release|format)$|version packages\b|patch release$|(rel|rls)[:,]"
    r"|(chore: )?prepare (\w+ )?v?\d+\.\d+"
    r"|release[/ ]+v?\d+(\.\d+)+\S*$|v?\d+\.\d+\.\d+\S*$|\S+-\d+(\.\d+)+-release$"
    r"|merge (back\b|(main|master)$|v?\d+(\.\d+)+$|(release |branch )?[`'\"]?(main|master|[\w.-]*(\d|/|release|stable|feature)[\w./-]*)"
    r"[`'\"]?( branch)? (in)?to [`'\"]?[\w./-]+[`'\"]?( branch)?$)"
    r"|roll \S+ from [0-9a-f]{7,} to [0-9a-f]{7,}|localization updates\b|translations update from|\[autopr\b))"
)
#: Fixed names of development branches, and patterns of feature, release and maintenance branches and of versions.
DEV_BRANCHES = ("main", "master", "trunk", "develop", "dev", "canary", "next", "unstable")
FEATURE_BASE, RELEASE_BASE = r"^feat(ure)?[/-]", r"(?i)(release|stable|maint|hotfix|lts|^rc$|^branch|\d+[._-](\d+|x))"
MAINTENANCE_LINE, VERSION = r"(?i)([.-]x(-y|-dev)?$|^maintenance/)", r"\d+(?:[._-](?:\d+|x))+(?:-y)?"
#: Trailing pull request number of a title.
TITLE_NUMBER = r"\s*\(?#\d+\)?\s*$"


def is_agent(login: Column) -> Column:
    return F.coalesce(login.rlike(AGENT_LOGIN), F.lit(False))


def is_bot(login: Column, kind: Column) -> Column:
    """A missing account counts as a bot."""
    bot = F.coalesce(kind == "Bot", F.lit(False)) | login.rlike(BOT_LOGIN) | is_agent(login)
    return F.when(login.isNull(), True).otherwise(~login.isin(*HUMAN_LOGIN) & bot)


def is_ai(login: Column, kind: Column, repo: Column | None = None, by_actions: tuple = AI_BY_ACTIONS) -> Column:
    """A coding agent, an AI reviewer's bot (Copilot's is typed as a user), or the actions account of a repo that reviews by it."""
    named = (login.rlike(AI_LOGIN) | is_agent(login)) & (is_bot(login, kind) | F.lower(login).contains("copilot"))
    if repo is not None:
        named = named | (repo.isin(*by_actions) & (login == ACTIONS_LOGIN))
    return F.coalesce(named, F.lit(False))


def author_kind(login: Column, kind: Column, repo: Column | None = None, by_actions: tuple = AI_BY_ACTIONS) -> Column:
    return F.when(is_ai(login, kind, repo, by_actions), "ai").when(is_bot(login, kind), "bot").otherwise("human")


def thread_author_kind(opener: Column, opener_kind: Column, pr_author: Column, repo: Column | None = None, by_actions: tuple = AI_BY_ACTIONS) -> Column:
    return F.when(opener == pr_author, "pr_author").otherwise(author_kind(opener, opener_kind, repo, by_actions))


def pr_author_kind(login: Column, kind: Column) -> Column:
    return F.when(is_agent(login), "ai").otherwise(author_kind(login, kind))


def keep_pr(title: Column, login: Column, kind: Column) -> Column:
    """By people or coding agents, and no release ceremony, backport or automation by its title."""
    return (is_agent(login) | ~is_bot(login, kind)) & ~F.coalesce(title, F.lit("")).rlike(EXCLUDED_TITLE)


def on_release_branch(title: Column, base: Column, default: Column) -> Column:
    """An unmarked backport, told by its base branch: a maintenance line, or a base that the title names or numbers."""
    said, version = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.regexp_extract(base, VERSION, 0))
    named = F.rlike(said, F.concat(F.lit(r"(?<![\w.])\Q"), version, F.lit(r"\E(?!\w|\.\d)")))
    aside = (base != "") & (default != "") & (base != default) & ~base.isin(*DEV_BRANCHES) & ~base.rlike(FEATURE_BASE)
    found = (
        base.rlike(MAINTENANCE_LINE) | F.startswith(said, F.concat(F.lower(base), F.lit(":"))) | ((version != "") & named)
        | (base.rlike(RELEASE_BASE) & said.rlike(r"\(#\d+\)$"))
    )
    return F.coalesce(aside & found, F.lit(False))


def normalized_title(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, TITLE_NUMBER, "")))


def drop_branch_copies(prs: DataFrame) -> DataFrame:
    """prs (repo, number, title, base_ref, created_at) without copies of an earlier PR's title aimed at another base.

    The earliest PR per title is found by a partial aggregation and joined back, so a popular title isn't one task's.
    """
    rows = prs.withColumn("_title", normalized_title(F.col("title")))
    first = rows.groupBy("repo", "_title").agg(F.min_by("base_ref", F.struct("created_at", "number")).alias("_base"))
    return rows.join(first, ["repo", "_title"]).filter(F.col("base_ref").eqNullSafe(F.col("_base"))).select(*prs.columns)


def exclude_repos(prs: DataFrame, excluded: DataFrame, renames: DataFrame) -> DataFrame:
    """prs without excluded repos, by their present names, whatever the case. Both lists are configuration."""
    now = renames.select(F.lower("old").alias("_old"), F.lower("new").alias("_new"))
    rows = prs.join(F.broadcast(now), F.lower("repo") == F.col("_old"), "left")
    rows = rows.withColumn("_name", F.coalesce("_new", F.lower("repo")))
    gone = excluded.select(F.lower("repo").alias("_gone"))
    return rows.join(F.broadcast(gone), F.col("_name") == F.col("_gone"), "left_anti").select(*prs.columns)


def reject_reason(listed: DataFrame, stored: DataFrame, flags: DataFrame, landed_by_commit: tuple = LANDED_BY_COMMIT) -> DataFrame:
    """listed (repo, number, title, author, author_type, base_ref, default_branch, created_at, corpus, targeted,
    closed_by_commit) with the first reason that rejects a row; null if it is kept.

    stored (repo, number): what there is already. flags (repo, number, by_human, by_ai, changes_requested): reviews.
    """
    key = ["repo", "number"]
    known = stored.select(*key).distinct().withColumn("_stored", F.lit(True))
    originals = drop_branch_copies(listed.select(*key, "title", "base_ref", "created_at")).select(*key).distinct().withColumn("_original", F.lit(True))
    reviews = flags.select(*key, *(F.col(c).alias(f"_{c}") for c in ("by_human", "by_ai", "changes_requested")))
    rows = listed.join(known, key, "left").join(originals, key, "left").join(reviews, key, "left")
    missing = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("_stored"), "already_stored").when(F.col("targeted") & missing("_changes_requested"), "no_changes_requested")
        .when(~keep_pr(F.col("title"), F.col("author"), F.col("author_type")), "bot_or_release_title")
        .when(on_release_branch(F.col("title"), F.col("base_ref"), F.col("default_branch")), "release_branch").when(missing("_original"), "branch_copy")
        .when(F.col("repo").isin(*landed_by_commit) & missing("closed_by_commit"), "not_landed")
        .when((F.col("corpus") == "human") & missing("_by_human"), "no_human_review").when((F.col("corpus") == "ai_feedback") & missing("_by_ai"), "no_ai_review")
    )
    return rows.withColumn("reason", reason).select(*listed.columns, "reason")


def route_corpus(prs: DataFrame, threads: DataFrame) -> DataFrame:
    """Human-review PRs without a thread opened by a human become approval-only, and back; benchmark PRs stay."""
    human = threads.groupBy("repo", "number").agg(F.max((F.col("author_kind") == "human").cast("int")).alias("_human"))
    rows = prs.join(human, ["repo", "number"], "left")
    routed = F.when(F.coalesce("_human", F.lit(0)) == 1, "human").otherwise("approval_only")
    moves = F.col("corpus").isin("human", "approval_only") & (F.col("source") != "benchmark")
    return rows.withColumn("routed", F.when(moves, routed).otherwise(F.col("corpus"))).drop("_human")


def take_quotas(listed: DataFrame, group: list[str], quota: Column, order: list) -> DataFrame:
    """The first `quota` rows of each group in order."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return listed.withColumn("rank", turn).filter(F.col("rank") <= quota)
