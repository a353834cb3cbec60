"""Scalar text, path and hash functions as Column expressions (D-family)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOISE_HEADINGS = ("checklist", "environment", "logs", "traceback", "stack trace", "system info", "versions")
PY_PATH = r"(?U)\b(?:[\w.-]+/)+[\w.-]+\.py\b"
CONFIDENCE = {"high": 1.0, "medium": 0.6, "low": 0.2}
DOMAINS = (
    ("web_framework", ("flask", "django", "fastapi")),
    ("networking", ("requests", "httpx", "urllib")),
    ("testing_tooling", ("pytest", "nose", "tox")),
    ("data_ml", ("pandas", "keras", "transformers", "langchain", "scikit")),
    ("app_cli", ("yt-dlp", "autogpt", "cli")),
)
BENCHMARKS = (("SWE-PolyBench", "polybench"), ("SWE-bench", "swe-bench"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """The runs of ASCII letters and digits, lower-cased, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(text: Column | str) -> Column:
    """The distinct tokens, in order of first appearance."""
    return F.array_distinct(tokens(text))


def path_tokens(path: Column | str) -> Column:
    """D3: the distinct tokens of a path's parts without their last extension; backslashes are slashes."""
    parts = F.transform(F.split(F.translate(col(path), "\\", "/"), "/"), lambda p: tokens(F.regexp_replace(p, r"\.[^.]*$", "")))
    return F.array_distinct(F.flatten(parts))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("long")


def query_token_estimate(text: Column | str) -> Column:
    return token_estimate(F.trim(col(text)))


def normalize_path(path: Column | str) -> Column:
    """Trimmed, forward slashes, without leading "./"s and one leading slash."""
    p = F.replace(F.trim(F.coalesce(col(path), F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), "^/", "")


def normalize_paths(paths: Column | str) -> Column:
    """Normalised, empty ones dropped, first occurrences kept."""
    return F.array_distinct(F.filter(F.transform(col(paths), normalize_path), lambda p: p != ""))


def gold_files_from_diff(patch: Column | str) -> Column:
    """The new paths of the diff headers, first occurrences."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col(patch), F.lit("")), F.lit(r"(?m)^diff --git a/.+ b/(.+)$"), F.lit(1)))


def gold_files_from_text(files: Column | str) -> Column:
    """A list written with commas, semicolons or lines."""
    return normalize_paths(F.split(F.coalesce(col(files), F.lit("")), "[,;\n]"))


def redact_paths(text: Column | str) -> Column:
    """D11."""
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), PY_PATH, "<PY_PATH>")


def compact_issue(text: Column | str, max_chars: int = 4000, redact: bool = True) -> Column:
    """An issue text without fences, noise sections and check boxes, capped.

    A heading of two to six hashes opens a section; splitting where a line begins with one keeps headings with bodies.
    """
    clean = F.regexp_replace(F.coalesce(col(text), F.lit("")), "\r\n?", "\n")
    clean = F.regexp_replace(clean, r"(?s)```.*?```", "\n")
    heading = r"^\s{0,3}#{2,6}\s+(.+?)\s*$"
    first_line = r"^([^\n]*)"
    noise = "|".join(NOISE_HEADINGS)

    def block(section: Column) -> Column:
        title = F.regexp_extract(F.regexp_extract(section, first_line, 1), heading, 1)
        body = F.when(title != "", F.regexp_replace(section, r"^[^\n]*\n?", "")).otherwise(section)
        body = F.regexp_replace(body, r"(?m)^[ \t]*[-*][ \t]*\[[xX ]\][ \t]+[^\n]*\n?", "")
        body = F.regexp_replace(body, r"^\s+|\s+$", "")
        shown = F.when(title != "", F.concat(F.lit("### "), title, F.lit("\n"), body)).otherwise(body)
        return F.when((body == "") | F.lower(title).rlike(noise), F.lit("")).otherwise(shown)

    sections = F.split(clean, r"(?m)(?=^[ \t]{0,3}#{2,6}[ \t]+\S)")
    joined = F.array_join(F.filter(F.transform(sections, block), lambda b: b != ""), "\n\n")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    out = F.when(strip(joined) == "", strip(clean)).otherwise(strip(joined))
    out = strip(F.regexp_replace(out, "\n{3,}", "\n\n"))
    if redact:
        out = redact_paths(out)
    short = F.concat(F.regexp_replace(F.substring(out, 1, max_chars - 3), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(out) > max_chars, short).otherwise(out)


def files_in_answer(text: Column | str) -> Column:
    """Files that a model's answer lists, as JSON or else as any Python paths in it."""
    t = F.coalesce(col(text), F.lit(""))
    as_json = F.from_json(F.regexp_extract(t, r'(?s)(\{[^{}]*"files"\s*:\s*\[[^\]]*\][^{}]*\})', 1), "files array<string>")["files"]
    loose = F.array_distinct(F.regexp_extract_all(t, F.lit(r"([\w/.-]+\.py)"), F.lit(1)))
    return F.coalesce(as_json, loose)


def json_object(text: Column | str, schema: str) -> Column:
    """A JSON object that is all of the text, or reaches from its first to its last brace."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.when(t.startswith("{") & t.endswith("}"), t), schema), F.from_json(F.nullif(inner, F.lit("")), schema))


def extract_patch(text: Column | str) -> Column:
    """The patch between tags, or else a bare unified diff with a hunk; null if there is none or it is refused."""
    t = F.coalesce(col(text), F.lit(""))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tagged = F.regexp_extract(t, r"(?s)<patch>(.*?)</patch>", 1)
    bare = strip(F.regexp_replace(F.regexp_extract(t, r"(?s)(--- a/.*)", 1), r"(?s)\n```.*$", ""))
    bare = F.when(bare.contains("+++ b/") & bare.rlike(r"(?m)^@@ .*@@"), bare)
    found = F.when(t.rlike("(?s)<patch>.*?</patch>"), strip(tagged)).otherwise(bare)
    found = F.when((found == "") | found.rlike(r"(?i)CANNOT_PATCH"), F.lit(None)).otherwise(found)
    return F.when(found.endswith("\n"), found).otherwise(F.concat(found, F.lit("\n")))


def is_test_file(path: Column | str) -> Column:
    """D16, whatever the case and the slashes."""
    p = F.lower(F.translate(col(path), "\\", "/"))
    return p.rlike(r"(^|/)(tests|testing)(/|$)|(^|/)test_[^/]*/*$|_test\.py/*$")


def issue_set_id(repo: Column | str, ids: Column | str) -> Column:
    """A stable name of a repository's set of issues."""
    named = F.array_sort(F.filter(col(ids), lambda i: i != ""))
    return F.concat(F.lit("issues_"), F.substring(F.sha1(F.concat_ws("|", col(repo), F.array_join(named, "|"))), 1, 12))


def suite_id(settings: Mapping[str, Any]) -> str:
    """A stable name of a configuration: a missing track or snapshot counts as empty, prefixes as a list."""
    filled = dict(settings) | {k: settings.get(k) or "" for k in ("evaluation_track", "snapshot_commit")}
    filled |= {"source_prefixes": [*(settings.get("source_prefixes") or ())], "seed": settings.get("seed")}
    return f"suite_{hashlib.sha1(json.dumps(filled, sort_keys=True).encode()).hexdigest()[:12]}"


def harness_id(prefix: str, run_id: Column | str, method: Column | str, results_path: Column | str, given: Column | str | None = None) -> Column:
    """The given name, or else one of the run, its method and the digest of where its results go."""
    made = F.concat_ws("_", F.lit(prefix), col(run_id), name_slug(method), F.substring(F.sha1(col(results_path)), 1, 8))
    return made if given is None else F.coalesce(F.nullif(col(given), F.lit("")), made)


def slug(text: Column | str) -> Column:
    """D18, of experiments: letters and digits in small letters, slashes and dashes as underscores, all else left out."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[/-]", "_"), r"[^\p{L}\p{N}_]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit("exp"))


def name_slug(text: Column | str) -> Column:
    """D18, of runs: runs of anything but letters and digits as one dash."""
    dashed = F.regexp_replace(F.lower(F.trim(F.coalesce(col(text), F.lit("")))), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-|-$", ""), F.lit("")), F.lit("unknown"))


def benchmark_of(dataset: Column | str) -> Column:
    """The first family whose mark the name holds."""
    name, out = F.lower(F.coalesce(col(dataset), F.lit(""))), F.lit("other")
    for family, mark in reversed(BENCHMARKS):
        out = F.when(name.contains(mark), family).otherwise(out)
    return out


def domain_of(repo: Column | str, explicit: Column | None = None) -> Column:
    name, out = F.lower(F.coalesce(col(repo), F.lit(""))), F.lit("library")
    for domain, marks in reversed(DOMAINS):
        out = F.when(name.rlike("|".join(marks)), domain).otherwise(out)
    return out if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), out)


def embedding_text(name: Column | str, kind: Column | str, signature: Column | str, docstring: Column | str) -> Column:
    """D20."""
    sig = F.when((col(kind) == "function") & (F.coalesce(col(signature), F.lit("")) != ""), col(signature)).otherwise("")
    doc = F.when(F.coalesce(col(docstring), F.lit("")) != "", F.concat(F.lit(": "), F.substring(col(docstring), 1, 200))).otherwise("")
    return F.concat(F.coalesce(col(name), F.lit("")), sig, doc)


def confidence_weight(label: Column | str) -> Column:
    """An unknown label counts as medium."""
    out = F.lit(CONFIDENCE["medium"])
    for name, weight in CONFIDENCE.items():
        out = F.when(F.lower(col(label)) == name, F.lit(weight)).otherwise(out)
    return out


def confidence_label(weight: Column | str) -> Column:
    return F.when(col(weight) >= 0.8, "high").when(col(weight) >= 0.4, "medium").otherwise("low")


def min_max(score: Column | str, window) -> Column:
    """To 0..1 within the window; all 1 where the range is nothing."""
    low, high = F.min(col(score)).over(window), F.max(col(score)).over(window)
    return F.when(high - low <= 1e-12, F.lit(1.0)).otherwise((col(score) - low) / (high - low))


def method_of_model(name: Column | str, prefix: str) -> Column:
    """D23."""
    n = col(name)
    return F.when(n.startswith(prefix), F.substring(n, len(prefix) + 1, 1_000_000)).otherwise(n)


def excerpt(text: Column | str, chars: int = 400) -> Column:
    """D24."""
    return F.substring(F.trim(F.regexp_replace(col(text), r"\s+", " ")), 1, chars)


def patch_prompt(issue: Column, files: Column, correction: Column | None = None) -> Column:
    """Sections by lines; `files` is an array of structs of path and content."""
    shown = F.array_join(F.transform(files, lambda f: F.concat(F.lit("--- "), f["path"], F.lit("\n"), f["content"])), "\n")
    parts = [F.concat(F.lit("Issue:\n"), issue), F.concat(F.lit("Files:\n"), shown)]
    if correction is not None:
        parts.append(F.when(correction.isNotNull(), F.concat(F.lit("Correction:\n"), correction)))
    return F.concat_ws("\n\n", *parts)
