"""Scalar functions as column expressions: names, commands, texts, vectors, times. Nothing here leaves the JVM."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: model name variants -------------------------------------------------------------------------------
CLAUDE_VARIANTS = ["opus", "sonnet", "haiku"]
GEMINI_VARIANTS = ["pro", "flash", "ultra"]

# --- Fixed values: shell command categories, in the order in which they are tried ---------------------------------------
#: category: (words anywhere, first words, words after a pipe, patterns)
SHELL_CATEGORIES: dict[str, tuple[list[str], list[str], list[str], list[str]]] = {
    "test": (["pytest", "jest", "vitest", "mocha"], [], [], [r"\bcargo\s+test\b", r"\bgo\s+test\b", r"\bnpm\s+test\b"]),
    "lint": ([], ["ruff", "eslint", "mypy", "pylint", "flake8", "black", "isort"], [], [r"\buv\s+run\s+ty\b", r"\buv\s+run\s+ruff\b"]),
    "vcs": ([], ["git", "yadm", "gh"], [], []),
    "search": ([], ["grep", "rg", "find", "ag"], ["grep", "rg"], []),
    "file": ([], ["ls", "cat", "head", "tail", "mv", "cp", "rm", "mkdir", "tree", "wc", "nl", "touch", "chmod", "chown", "ln", "sed", "awk"], ["head", "tail", "wc", "nl", "sed", "awk"], []),
    "remote": ([], ["ssh", "scp", "rsync", "curl", "wget", "ping", "dig", "nc", "netstat"], [], []),
    "db": ([], ["sqlite3", "sqlite-utils", "psql", "mysql"], ["sqlite3"], []),
    "infra": ([], ["docker", "terraform", "ansible", "kubectl", "k9s", "helm"], [], []),
    "ai": ([], ["claude", "gemini", "aider", "codex"], [], []),
    "python": ([], ["python", "python3"], [], [r"\buv\s+run\s+python"]),
    "node": ([], ["npm", "node", "yarn", "pnpm", "npx", "bun"], [], []),
    "package": ([], ["pip", "brew", "apt", "cargo"], [], [r"^uv\s+(?!run)"]),
    "shell": ([], ["echo", "sleep", "source", ".", "date", "which", "pwd", "env", "export", "bash", "zsh", "sh", "tmux", "screen", "open", "pbcopy", "pbpaste", "for", "while", "if", "case", "test", "["], [], []),
}

#: Starts of binary files, as characters of the same numbers.
BINARY_STARTS = ["SQLite format 3", "\x89PNG", "%PDF", "GIF87a", "GIF89a", "\xff\xd8\xff"]
#: Parts of a JSON text that may hold binary data: base64 blocks, and the base64 of PNG, PDF and JPEG starts.
BINARY_HINTS = ['"type": "base64"', '"type":"base64"', "iVBORw0KGgo", "JVBERi0", "/9j/"]
BASE64_RUN = r"[A-Za-z0-9+/]{500,}={0,2}"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim knows only the space)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def json_text(content: Column) -> Column:
    """FN-01: the `text` of a JSON block."""
    return F.get_json_object(content, "$.text")


def json_text_or_raw(content: Column) -> Column:
    """FLT-20: the `text` of a JSON block, the string itself where there is none."""
    return F.coalesce(json_text(content), content)


def day(ts: Column) -> Column:
    """FN-02: the day of an ISO text."""
    return F.substring(ts, 1, 10)


def suffix(c: Column, n: int) -> Column:
    """FN-02: the last n characters; all of a shorter text."""
    return F.substring(c, -n, n)


def week_of_year(ts: Column) -> Column:
    """FN-04: `%Y-W%W`: weeks begin on Monday; days before the first one are week 00."""
    d = F.to_date(day(ts))
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def parse_date(value: str | None, today: dt.date | None = None) -> str | None:
    """FN-06: `today`, `yesterday`, `7d`, `2w`, `YYYY-MM-DD` as an ISO day. Anything else is an error."""
    if value is None:
        return None
    today, value = today or dt.date.today(), value.strip().lower()
    if value in ("today", "yesterday"):
        return (today - dt.timedelta(days=value == "yesterday")).isoformat()
    if m := re.fullmatch(r"(\d+)([dw])", value):
        return (today - dt.timedelta(days=int(m[1]) * (7 if m[2] == "w" else 1))).isoformat()
    return dt.date.fromisoformat(value).isoformat()


def parse_timestamp(ts: Column) -> Column:
    """FN-07: an ISO text as a timestamp, without an offset in UTC (the session's zone is UTC); null if it isn't one."""
    return F.try_to_timestamp(ts)


def is_newer(ts: Column, than: Column) -> Column:
    """FN-07: a time is newer than no time; no time is newer than nothing."""
    return F.when(ts.isNull(), False).when(than.isNull(), True).otherwise(parse_timestamp(ts) > parse_timestamp(than))


def model_name(raw: Column) -> Column:
    """FN-08: name, creator, family, version, variant, released of a raw model name; of one of no known make the name alone.

    A name's parts stand between hyphens. Between `claude` and a date are one variant and its version, two numbers where the variant comes first, else one or two;
    after `gemini` come a number, a variant, and perhaps `preview`."""
    part = F.split(raw, "-")
    last, inner = F.try_element_at(part, F.lit(-1)), F.slice(part, 2, F.greatest(F.size(part) - 2, F.lit(0)))
    is_number = lambda x: x.rlike(r"^\d+$")
    numbers, words = F.filter(inner, is_number), F.filter(inner, lambda x: ~is_number(x))
    variant = F.get(words, F.lit(0))
    ordered = F.when(F.get(inner, F.lit(0)) == variant, F.size(numbers) == 2).otherwise((F.try_element_at(inner, F.lit(-1)) == variant) & F.size(numbers).between(1, 2))
    claude = (F.get(part, F.lit(0)) == "claude") & (F.size(words) == 1) & variant.isin(CLAUDE_VARIANTS) & last.rlike(r"^\d{8}$") & ordered
    gemini = (F.get(part, F.lit(0)) == "gemini") & F.get(part, F.lit(1)).rlike(r"^\d+(\.\d+)?$") & F.get(part, F.lit(2)).isin(GEMINI_VARIANTS) & ((F.size(part) == 3) | ((F.size(part) == 4) & (last == "preview")))

    def made(name: Column, **known: Column) -> Column:
        return F.struct(name.alias("name"), *(known.get(k, F.lit(None)).cast("string").alias(k) for k in ("creator", "family", "version", "variant", "released")))

    date = F.concat_ws("-", F.substring(last, 1, 4), F.substring(last, 5, 2), F.substring(last, 7, 2))
    return (
        F.when(claude, made(F.array_join(F.slice(part, 1, F.size(part) - 1), "-"), creator=F.lit("anthropic"), family=F.lit("claude"), version=F.array_join(numbers, "."), variant=variant, released=date))
        .when(gemini, made(F.array_join(F.slice(part, 1, 3), "-"), creator=F.lit("google"), family=F.lit("gemini"), version=F.get(part, F.lit(1)), variant=F.get(part, F.lit(2))))
        .otherwise(made(raw))
    )


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once a row, however often f names it."""
    return F.transform(F.array(value), f)[0]


def shell_category(command: Column) -> Column:
    """FN-09: the category of a shell command, null if none fits; the first category that fits counts."""
    return once(command, _category)


def _category(command: Column) -> Column:
    first = F.split(strip(F.regexp_replace(command, r"^cd\s+[^&]+&&\s*", "")), r"\s+")[0]
    out = None
    for category, (words, firsts, pipes, patterns) in SHELL_CATEGORIES.items():
        tests = [command.contains(w) for w in words]
        tests += [command.rlike(p) for p in patterns]
        tests += [first.isin(firsts)] if firsts else []
        tests += [command.rlike(rf"\|\s*{p}\b") for p in pipes]
        fits = any_of(tests)
        out = F.when(fits, category) if out is None else out.when(fits, category)
    return F.when(F.coalesce(F.length(command), F.lit(0)) > 0, out)


def command_of(tool_input: Column) -> Column:
    """The command in a shell call's JSON input: `command`, else `cmd`; an empty one counts as none."""
    some = lambda key: F.nullif(F.get_json_object(tool_input, f"$.{key}"), F.lit(""))
    return F.coalesce(some("command"), some("cmd"))


def is_derivative(tool: Column, tool_input: Column, program: str) -> Column:
    """FN-10: the call searches this history itself: `<program> ask|query|search` in a shell, or the skill of that name."""
    shell = once(F.coalesce(command_of(tool_input), F.lit("")), lambda command: any_of([command.contains(f"{program} {w}") for w in ("ask", "query", "search")]))
    skill = F.coalesce(F.get_json_object(tool_input, "$.skill"), F.lit("")) == program
    return F.when(tool == "shell.execute", shell).when(tool == "skill.invoke", skill).otherwise(False)


def is_binary_block(block: Column) -> Column:
    """FN-11: an image or document block with base64 data."""
    kind = F.get_json_object(block, "$.type").isin("image", "document")
    return F.coalesce(kind & (F.get_json_object(block, "$.source.type") == "base64"), F.lit(False))


def is_binary_text(text: Column) -> Column:
    """FN-11: a NUL among the first 1000 characters, or the start of a known binary format."""
    return F.coalesce(F.substring(text, 1, 1000).contains("\x00") | any_of([text.startswith(s) for s in BINARY_STARTS]), F.lit(False))


def has_base64_run(text: Column) -> Column:
    """FN-11: 500 characters of base64 or more in a row."""
    return F.coalesce(text.rlike(BASE64_RUN), F.lit(False))


def may_hold_binary(content: Column) -> Column:
    """FLT-18: the cheap test before the exact ones."""
    return any_of([content.contains(x) for x in BINARY_HINTS])


def without_binary(block: Column) -> Column:
    """FN-12: a JSON block whose base64 data is replaced by its size and kind; other blocks as they are."""
    replaced = F.to_json(F.struct(
        F.get_json_object(block, "$.type").alias("type"),
        F.struct(
            F.lit("filtered").alias("type"),
            F.get_json_object(block, "$.source.type").alias("original_type"),
            F.get_json_object(block, "$.source.media_type").alias("media_type"),
            F.length(F.coalesce(F.get_json_object(block, "$.source.data"), F.lit(""))).alias("original_size"),
            F.lit("binary_content").alias("filtered_reason"),
        ).alias("source"),
        F.get_json_object(block, "$.cache_control").alias("cache_control"),
    ))
    return F.when(is_binary_block(block), replaced).otherwise(block)


def result_without_binary(result: Column) -> Column:
    """FN-12: a JSON tool result whose `content` string is binary or holds a long base64 run, with a note instead; lists of blocks each by without_binary."""
    content = F.get_json_object(result, "$.content")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(result), "$.content", "variant"))
    note = lambda what: F.to_json(F.struct(F.lit(f"[{what} content filtered]").alias("content"), F.length(content).alias("original_size"), F.lit(f"{what}_content").alias("filtered_reason")))
    blocks = F.transform(F.from_json(content, "array<string>"), without_binary)
    listed = F.concat(F.lit('{"content":['), F.array_join(blocks, ","), F.lit("]}"))
    return (
        F.when((kind == "STRING") & is_binary_text(content), note("binary"))
        .when((kind == "STRING") & has_base64_run(content), note("base64"))
        .when(kind.startswith("ARRAY") & F.exists(F.from_json(content, "array<string>"), is_binary_block), listed)
        .otherwise(result)
    )


#: A remote: scheme, user and port are left behind; host and path are kept, the path without `.git` or slashes at its end.
_REMOTE = r"^(?:(?:https?|ssh|git)://)?(?:[^@/]*@)?([^/:@]+)(?::\d+(?=/))?[:/]+(.*?)(?:\.git|/+)?$"


def remote_url(url: Column) -> Column:
    """FN-13: a git remote as host/path; a local path stays a path. What is neither stays as it is."""
    local, host, path = F.regexp_extract(url, r"^(?:file://)?(/.*?)/*$", 1), F.regexp_extract(url, _REMOTE, 1), F.regexp_extract(url, _REMOTE, 2)
    return F.when(local != "", local).when(host != "", F.regexp_replace(F.concat_ws("/", host, path), "//+", "/")).otherwise(url)


def content_hash(text: Column) -> Column:
    """FN-14: SHA-256 in lower-case hex."""
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """FN-15: a 26-character id that the same natural key always gets."""
    return F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 26))


def without_line_numbers(text: Column) -> Column:
    """FN-16: a listing without the numbers before each line."""
    return F.regexp_replace(text, r"(?m)^\s*\d+→", "")


def file_content(result: Column) -> Column:
    """FN-17: the text in a tool result: `content` or `output`, a string or a list of text blocks."""
    raw = F.coalesce(F.get_json_object(result, "$.content"), F.get_json_object(result, "$.output"))
    blocks = F.from_json(raw, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    return without_line_numbers(F.when(raw.startswith("[{") & (F.size(blocks) > 0), joined).otherwise(raw))


def basename(path: Column) -> Column:
    """FN-18: what follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def short_count(n: Column) -> Column:
    """FN-19: 950, 1.2k, 3.4M."""
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1_000_000, 1), F.lit("M"))).when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def ago(ts: Column, as_of: Column) -> Column:
    """FN-19: how long before as_of, in its largest unit."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(ts)
    unit = lambda size, name: F.concat(F.floor(s / size).cast("string"), F.lit(f"{name} ago"))
    return F.when(s < 60, F.lit("just now")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def truncated(text: Column, n: int) -> Column:
    """FN-19: at most n characters, the last three dots if some are missing."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def without_date(model: Column) -> Column:
    """FN-19: a model name without the date at its end."""
    return F.regexp_replace(model, r"-\d{8}$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """FN-20: cosine similarity; 0 for a vector without length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def sentences(text: Column) -> Column:
    """FN-22: split after . ! ? before white space, and at line feeds; no empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), strip), lambda s: F.length(s) > 0)


def token_count(text: Column) -> Column:
    """FN-23: words and single marks; the stand-in where no tokenizer is given."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))


def short_number(text: Column) -> Column:
    """FN-24: 4.5k, 1.2m or 500 as a long; null if it isn't a number."""
    x = F.lower(F.regexp_replace(F.trim(text), ",", ""))
    times = F.when(x.endswith("k"), 1000).when(x.endswith("m"), 1_000_000).otherwise(1)
    return (F.regexp_replace(x, "[km]$", "").try_cast("double") * times).cast("long")


def placeholder_text(blocks: Column) -> Column:
    """FN-26: the text of blocks (block_type, content), with a mark for what isn't text."""
    def one(b: Column) -> Column:
        kind = b["block_type"]
        return F.when(kind == "text", json_text(b["content"])).when(kind == "tool_use", F.concat(F.lit("[tool: "), F.coalesce(F.get_json_object(b["content"], "$.name"), F.lit("unknown")), F.lit("]"))).otherwise(F.concat(F.lit("["), kind, F.lit("]")))

    return F.array_join(F.filter(F.transform(blocks, one), lambda t: t.isNotNull() & (t != "")), "\n")


def or_terms(query: Column) -> Column:
    """FN-28: the words of three characters or more, quoted, joined by OR."""
    words = F.filter(F.regexp_extract_all(query, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")
