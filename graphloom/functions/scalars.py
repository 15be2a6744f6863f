"""Scalar functions over paths, sizes, texts and names, all as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def lookup(table: dict, key: Column) -> Column:
    """Value of a literal map, null where the key is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def human_size(n: Column) -> Column:
    """B, KB, MB with one decimal, halves to even."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1024 * 1024), 1)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """With the dot; leading dots of a name make no extension."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def top_folder(path: Column) -> Column:
    """First path part, or (root) for a file without a folder."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def module(path: Column, levels: int) -> Column:
    """The first ``levels`` folders of a path, fewer where it has fewer."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.least(depth(path), F.lit(levels)), F.lit(0)))
    return F.when(depth(path) == 0, "(root)").otherwise(F.array_join(folders, "/"))


def slug(text: Column) -> Column:
    """C4."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "root").otherwise(s)


def size_class(degree: Column) -> Column:
    """By in + out."""
    return F.when(degree >= 10, "xl").when(degree >= 6, "lg").when(degree >= 3, "md").when(degree >= 1, "sm").otherwise("xs")


def dot_escape(text: Column) -> Column:
    """Backslash before quote."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def mermaid_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]", "_")


def loc(text: Column) -> Column:
    """Lines that are not blank; all Unicode line ends count."""
    lines = F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    return F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"\s", "") != ""))


def token_estimate(size: Column) -> Column:
    """C11."""
    return F.greatest(F.floor(size / 4), F.lit(1)).cast("long")


def sample_hash(content: Column) -> Column:
    """C7 without a text: md5 of the whole, or of the first 8 KB and last 2 KB beyond 10 KB (binary)."""
    return F.when(F.octet_length(content) <= 10240, F.md5(content)).otherwise(F.md5(F.concat(F.substring(content, 1, 8192), F.substring(content, -2048, 2048))))


def set_hash(items: Column) -> Column:
    """md5 of the sorted distinct, trimmed, lower-case, non-blank items; '' for none."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
    return F.when(F.size(clean) > 0, F.md5(F.array_join(clean, "|"))).otherwise("")


def list_hash(items: Column) -> Column:
    """md5 of the sorted items with repeats, as JSON; only equality matters."""
    return F.md5(F.to_json(F.array_sort(items)))


def numbered(text: Column, start: Column) -> Column:
    """Each line as 'n | line'."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((start + i).cast("string"), F.lit(" | "), x)), "\n")


def middle_cut(text: Column, limit: int, mark: str = "\n... [truncated] ...\n") -> Column:
    """C17: first and last half around a mark when longer than the limit."""
    half = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, half), F.lit(mark), F.substring(text, -half, half)))


def node_type(raw: Column) -> Column:
    """Alias, else layer of a path-like value, else other."""
    key = F.lower(F.trim(raw))
    pathlike = key.contains("/") | key.contains("\\") | key.rlike(r"\.(py|js|ts|go|rs)$")
    return F.coalesce(lookup(V.NODE_TYPES, key), F.when(pathlike, layer_of_path(key)), F.lit("other"))


def edge_type(raw: Column) -> Column:
    return F.coalesce(lookup(V.EDGE_TYPES, F.lower(F.trim(raw))), F.lit("imports"))


def role_name(raw: Column) -> Column:
    return F.coalesce(lookup(V.ROLES, F.translate(F.lower(F.trim(raw)), "- ", "__")), F.lit("unknown"))


def complexity_score(raw: Column) -> Column:
    """Exact word, number (clamped to 1..9), first known word or number 1..9 inside, else 3."""
    text = F.lower(F.trim(raw))
    whole = text.try_cast("bigint")
    words = F.filter(F.split(F.translate(text, ",/()", "    "), r"\s+"), lambda w: w != "")
    value = lambda w: F.coalesce(lookup(V.COMPLEXITY, w).cast("bigint"), F.when(w.try_cast("bigint").between(1, 9), w.try_cast("bigint")))
    inside = F.try_element_at(F.filter(F.transform(words, value), lambda v: v.isNotNull()), F.lit(1))
    return F.coalesce(lookup(V.COMPLEXITY, text).cast("bigint"), F.when(whole.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(9), whole))), inside, F.lit(3)).cast("int")


def layer_of_path(path: Column) -> Column:
    """first layer with a keyword inside the lower-case path, else other."""
    low = F.lower(path)
    rules = [(reduce(lambda a, b: a | b, [low.contains(k) for k in words]), layer) for layer, words in V.LAYER_KEYWORDS]
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise("other")


def node_layer(role: Column, path: Column) -> Column:
    """The role's layer unless that is other or absent."""
    return F.coalesce(F.nullif(lookup(V.ROLE_LAYERS, role), F.lit("other")), layer_of_path(path))


def client_ip(forwarded: Column, peer: Column, hops: int) -> Column:
    """The hops-th entry from the right of the forwarded chain, else the peer."""
    chain = F.transform(F.split(forwarded, ","), lambda x: F.trim(x))
    return F.coalesce(F.nullif(F.try_element_at(chain, F.lit(-hops)), F.lit("")), peer)


def is_technical(question: Column) -> Column:
    """F8."""
    low = F.lower(question)
    return reduce(lambda a, b: a | b, [low.contains(k) for k in V.TECHNICAL_KEYWORDS])


def matches_any(text: Column, patterns: list[str]) -> Column:
    """case-insensitive search of any pattern."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def is_doc_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(d) for d in V.DOC_DIRS]))


def is_ci_path(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(path).contains(c) for c in V.CI_PARTS])


def language(path: Column) -> Column:
    """by file name, else by lower-case extension, else Unknown."""
    return F.coalesce(lookup(V.FILENAME_LANGUAGES, basename(path)), lookup(V.EXTENSION_LANGUAGES, F.lower(extension(path))), F.lit("Unknown"))


def skip_reason(path: Column, size: Column) -> Column:
    """null for a file to keep; reasons in order."""
    name, ext = basename(path), F.lower(extension(path))
    secret = name.isin(V.SECRET_NAMES) | name.startswith(".env") | name.rlike("(?:" + "|".join(re.escape(x) for x in V.SECRET_SUFFIXES) + ")$")
    notebook = ext == ".ipynb"
    return (
        F.when(name.isin(V.IGNORED_FILES), "ignored_filename")
        .when(secret, "secret_file")
        .when(ext.isin(V.IGNORED_EXTENSIONS), "ignored_extension")
        .when(name.startswith(".") & lookup(V.FILENAME_LANGUAGES, name).isNull(), "hidden_file")
        .when(~notebook & (size > V.MAX_FILE_BYTES), F.lit(f"exceeds_max_size_{V.MAX_FILE_BYTES // 1024}KB"))
        .when(notebook & (size > V.MAX_NOTEBOOK_BYTES), F.lit(f"exceeds_max_size_{V.MAX_NOTEBOOK_BYTES // 1024}KB"))
    )


def pruned_dir(path: Column) -> Column:
    """some folder of the path is hidden or ignored."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(depth(path), F.lit(0)))
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(V.IGNORED_DIRS))


def compact_number(n: Column) -> Column:
    """C20."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fK", n / 1000)).otherwise(n.cast("long").cast("string"))


def parse_shape(text: Column) -> Column:
    """Positive integers split at x, the times sign, commas or blanks; null if any part is not."""
    parts = F.filter(F.split(F.trim(text), "[×x,\\s]+"), lambda p: p != "")
    nums = F.transform(parts, lambda p: p.try_cast("int"))
    return F.when((F.size(nums) > 0) & ~F.exists(nums, lambda v: v.isNull() | (v <= 0)), nums)


def module_radius(files: Column) -> Column:
    """C22."""
    return F.least(F.lit(22.0) + F.lit(5.0) * F.sqrt(files), F.lit(55.0))


def question_text(flag: Column, size: Column, partner: Column) -> Column:
    """Interview question of a flag."""
    lines = F.format_number(F.greatest(F.floor(size / V.GOD_BYTES_PER_LINE), F.lit(1)), 0)
    a, b = V.QUESTIONS["in_cycle"].split("{other}")
    c, d = V.QUESTIONS["god_file"].split("{lines}")
    return (
        F.when(flag == "orphan", V.QUESTIONS["orphan"])
        .when(flag == "in_cycle", F.concat(F.lit(a), F.coalesce(partner, F.lit("another module")), F.lit(b)))
        .when(flag == "hub", V.QUESTIONS["hub"])
        .when(flag == "entry_point", V.QUESTIONS["entry_point"])
        .when(flag == "god_file", F.concat(F.lit(c), lines, F.lit(d)))
    )


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo, host, ok, reason) of an https repository address.

    Exact hosts only, no credentials, no port but 80 and 443, no backslash or '..'.
    """
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(rest, r":\d+$", ""))
    port = F.regexp_extract(rest, r":(\d+)$", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1), r"/+$", "")
    parts = F.split(F.regexp_replace(path, r"\.git$", ""), "/")
    gitlab = host == "gitlab.com"
    reason = (
        F.when(url.isNull() | (F.trim(url) == ""), "empty")
        .when(url.contains("\\") | url.contains(".."), "traversal")
        .when(F.lower(scheme) != "https", "scheme")
        .when(rest.contains("@"), "credentials")
        .when(~host.isin("github.com", "gitlab.com", "bitbucket.org"), "host")
        .when((port != "") & ~port.isin("80", "443"), "port")
        .when((F.size(parts) < 2) | (~gitlab & (F.size(parts) > 2)), "path")
        .when(F.exists(parts, lambda p: ~p.rlike(r"^[A-Za-z0-9_.-]+$")), "name")
    )
    return F.struct(
        F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("owner"),
        F.element_at(parts, -1).alias("repo"),
        host.alias("host"),
        reason.isNull().alias("ok"),
        reason.alias("reason"),
    )


def normalize_url(raw: Column) -> Column:
    """S3: trim, ssh to https, strip www, add a scheme, bare owner/repo to github.com."""
    s = F.trim(raw)
    s = F.regexp_replace(s, r"^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    s = F.when(s.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~F.split_part(s, F.lit("/"), F.lit(1)).rlike(r"\.(com|org|net)$"), F.concat(F.lit("https://github.com/"), s)).otherwise(s)
    s = F.when(s.rlike(r"(?i)^[a-z]+://"), s).otherwise(F.concat(F.lit("https://"), s))
    return F.regexp_replace(s, r"(?i)^(https?://)www\.", "$1")


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of a colour of three bytes."""

    def linear(c: Column) -> Column:
        x = c / 255
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def ink(r: Column, g: Column, b: Column) -> Column:
    """Dark text where the ground is light."""
    return F.when(luminance(r, g, b) > 0.179, "dark").otherwise("light")


def mix_colour(value: Column, low: Column, high: Column, a: Column, b: Column) -> Column:
    """A channel between two colours by the value's clamped share of its span; the first where there is none."""
    share = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))).otherwise(0.0)
    return F.round(a + (b - a) * share)
