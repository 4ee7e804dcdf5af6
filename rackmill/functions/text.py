"""String functions of the audit, as Columns. All patterns are plain enough for RE2 unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
#: Port class prefixes and their cable labels, tried in this order.
CABLE_LABELS = (("rj45", "RJ45"), ("hdmia", "HDMI"), ("hdmi", "HDMI"), ("lc", "LC"), ("sc", "SC"), ("bnc", "BNC"), ("usb", "USB"), ("ps2", "PS/2"), ("nema", "NEMA"), ("rs232", "RS-232"), ("sfp", "SFP"), ("xfp", "XFP"))
#: Words contained in a port class and the cable prefixes they stand for, tried in this order.
CABLE_ALIASES = (("ethernet", "rj45"), ("usb", "usb"), ("sc", "sc"), ("lc", "lc"), ("hdmi", "hdmia"), ("hdmi", "hdmi"), ("bnc", "bnc"), ("ps2", "ps2"), ("nema", "nema"), ("rs232", "rs232"), ("sfp", "sfp"), ("xfp", "xfp"))
#: Report categories in output order.
CATEGORIES = ("rack", "switch", "patchpanel", "cable", "empty_port", "connected_port")
#: Words in a report's name and the category they stand for, tried in this order.
CATEGORY_WORDS = (("rack", "rack"), ("patchpanel", "patchpanel"), ("patch_panel", "patchpanel"), ("switch", "switch"), ("cable", "cable"), ("connected_port", "connected_port"), ("empty_port", "empty_port"), ("ports_results", "empty_port"))
#: Forms in which a model's name tells its number of ports, with the group that has it, tried in this order.
PORT_COUNT_FORMS = ((r"-(\d{2})([A-Z]|$)", 1), (r"(GS|DGS|SGD|XS|XGS)\D*(\d{2})$", 2), (r"\d{2}(\d{2})$", 1))
#: Canonical colours in order of preference.
COLOURS = ("black", "blue", "green", "grey", "white", "yellow", "orange", "red", "brown", "purple", "pink", "beige", "cyan", "magenta")
# -------------------------------------------------------------------------------------------------


def let(value: Column, then) -> Column:
    """then(value), with value computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def alnum(s: Column) -> Column:
    """Lower-cased ASCII letters and digits; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]", "")


def spaced(s: Column) -> Column:
    """Underscores and hyphens as spaces, runs of white space as one, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(s, F.lit("")), "_-", "  "), r"\s+", " ")))


def underscored(s: Column) -> Column:
    return F.replace(F.trim(F.lower(F.coalesce(s, F.lit("")))), F.lit(" "), F.lit("_"))


def key(s: Column) -> Column:
    """The form in which composite keys are compared: trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(s, F.lit(""))))


def ocr(s: Column) -> Column:
    """Lower-cased, 0 and 1 read as o and l, other characters than letters, digits, space and hyphen as spaces."""
    read = F.translate(F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit("\\n"), F.lit(" ")), "01", "ol")
    return F.trim(F.regexp_replace(F.regexp_replace(read, r"[^a-z0-9\s-]", " "), r"\s+", " "))


def compact(s: Column) -> Column:
    """Letters, digits and backslashes, and the letter s whatever stands before it: spaces go, backslashes stay."""
    return F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^a-zA-Z0-9\\s]", ""))


def vendor_key(s: Column) -> Column:
    return alnum(F.translate(F.coalesce(s, F.lit("")), "‐‑–", "---"))


def model_key(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def safe_name(s: Column) -> Column:
    """A file name of letters, digits, hyphens and underscores."""
    return F.regexp_replace(s, "[^a-zA-Z0-9_-]", "_")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    ends = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ends)


def title(s: Column) -> Column:
    """Every run of letters with its first letter in upper case and the others in lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def port_count(model: Column) -> Column:
    """The number of ports that a model's name tells; null if none. Forms: -24TT, GS24, DGS..10."""
    m = F.upper(F.regexp_replace(F.coalesce(model, F.lit("")), r"\.[A-Za-z0-9]{1,5}$", ""))
    return F.coalesce(*(F.nullif(F.regexp_extract(m, p, g), F.lit("")) for p, g in PORT_COUNT_FORMS)).cast("int")


def cable_label(port: Column) -> Column:
    p = alnum(port)
    out = F.when(F.lit(False), "")
    for prefix, label in CABLE_LABELS:
        out = out.when(p.startswith(prefix) | (p.contains("rs232") if prefix == "rs232" else F.lit(False)), label)
    return out.otherwise(F.trim(title(F.coalesce(port, F.lit("")))))


def category(name: Column) -> Column:
    """A report's category by its name, with spaces and hyphens read as underscores; null if unknown. Found in another order than they are sorted in."""
    n = F.translate(F.lower(F.coalesce(name, F.lit(""))), " -", "__")
    out = F.when(F.lit(False), "")
    for word, found in CATEGORY_WORDS:
        out = out.when(n.contains(word), found)
    return out


def category_rank(name: Column) -> Column:
    c = category(name)
    out = F.when(F.lit(False), 0)
    for k, x in enumerate(CATEGORIES):
        out = out.when(c == x, k)
    return out.otherwise(999)


def one_line(s: Column) -> Column:
    return F.trim(F.translate(F.coalesce(s, F.lit("")), "\n\r", " "))


def one_line_or_null(s: Column) -> Column:
    """White space as single spaces; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(""))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_body(html: Column) -> Column:
    """What stands in <body>, else everything."""
    return F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1), F.lit("")), html)


def html_text(html: Column) -> Column:
    """The body without scripts, styles and tags, white space collapsed."""
    body = F.regexp_replace(html_body(html), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " "))


def html_unescape(s: Column) -> Column:
    """The five escaped characters and the fixed space as themselves."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_rows(html: Column, cell: str = "t[dh]") -> Column:
    """Arrays of cell texts, one for each <tr>. cell: which tags are cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(rf"(?is)<{cell}(?:\s[^>]*)?>(.*?)</{cell}>"), F.lit(1)))
    return F.transform(cells, lambda r: F.transform(F.transform(F.transform(r, _untagged), _unescaped), _single_spaced))


# most cells are plain, and a look for the character costs less than the replacement


def _untagged(c: Column) -> Column:
    return F.when(c.contains("<"), F.regexp_replace(c, r"(?s)<[^>]*>", "")).otherwise(c)


def _unescaped(c: Column) -> Column:
    return F.when(c.contains("&"), html_unescape(c)).otherwise(c)


def _single_spaced(c: Column) -> Column:
    white = c.contains("  ")
    for w in "\t\n\x0b\f\r":
        white = white | c.contains(w)
    return F.trim(F.when(white, F.regexp_replace(c, r"\s+", " ")).otherwise(c))


def _meaningful(html: Column, pictures: str) -> Column:
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    told = F.exists(F.slice(rows, 2, 1 << 30), lambda r: F.length(F.trim(F.regexp_replace(r, r"(?s)<[^>]*>", ""))) > 3)
    plain = F.length(F.trim(F.regexp_replace(html, r"(?s)<[^>]*>", "")))
    return F.coalesce(F.when(html.rlike(pictures), True).when(html.rlike(r"(?i)<table\b"), told).otherwise(plain > 30), F.lit(False))


def html_meaningful(html: Column) -> Column:
    """Pictures count; of a document with a table any row but the first with more than three characters of text; else more than 30 characters."""
    return _meaningful(html, r"(?i)<img\b|<picture\b|data:image/")


def body_meaningful(body: Column) -> Column:
    """The same for a report's body, in which drawings count as pictures and embedded data alone doesn't."""
    return _meaningful(body, r"(?i)<img|<picture|<svg|<canvas")


def html_keyed(html: Column) -> Column:
    """A two-column table as a map; of a repeated key the last value."""
    pairs = F.filter(html_rows(html), lambda r: F.size(r) >= 2)
    entries = F.transform(pairs, lambda r: F.struct(F.lower(F.get(r, F.lit(0))).alias("k"), F.get(r, F.lit(1)).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1 << 30), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


_ABSOLUTE = r"(?i)^(?:https?:|data:|file:|/)"


def _based(url: Column, base: Column) -> Column:
    return F.when(url.rlike(_ABSOLUTE), url).otherwise(F.concat(base, F.lit("/"), url))


def _each(html: Column, pattern: str, groups: int, written) -> Column:
    """html with every match of the pattern written anew. written: from an array of the match's groups."""
    between = F.split(html, pattern)
    matches = F.regexp_extract_all(html, F.lit(f"({pattern})"), F.lit(1))
    parts = F.transform(matches, lambda m: written([F.regexp_extract(m, pattern, g) for g in range(1, groups + 1)]))
    return F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(parts, i), F.lit("")))), "")


def rebased(html: Column, folder: Column) -> Column:
    """Relative src, href, url() and srcset addresses below file:///<folder>; http, data and file addresses and those from the root stay. Of a srcset every entry
    is one address and its size, and entries are separated by a comma and a space."""
    base = F.concat(F.lit("file:///"), F.regexp_replace(F.coalesce(folder, F.lit("")), "^/+|/+$", ""))

    def attribute(name: str):
        return lambda m: F.concat(F.lit(f"{name}="), m[0], _based(m[1], base), m[0])

    def entry(e: Column) -> Column:
        words = F.split(F.trim(e), r"\s+")
        return F.concat_ws(" ", _based(F.get(words, F.lit(0)), base), F.array_join(F.slice(words, 2, 1 << 30), " "))

    def entries(m: list[Column]) -> Column:
        own = F.filter(F.split(m[1], ","), lambda e: F.trim(e) != "")
        return F.concat(F.lit("srcset="), m[0], F.array_join(F.transform(own, lambda e: F.trim(entry(e))), ", "), m[0])

    html = _each(html, r"""(?<![A-Za-z])src=("|')([^"']+)["']""", 2, attribute("src"))
    html = _each(html, r"""(?<![A-Za-z])href=("|')([^"']+)["']""", 2, attribute("href"))
    html = _each(html, r"""(?i)url\(("|')?([^)"']+)["']?\)""", 2, lambda m: F.concat(F.lit("url("), m[0], _based(m[1], base), m[0], F.lit(")")))
    return _each(html, r"""(?i)srcset=("|')([^"']+)["']""", 2, entries)


def no_images(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)no[_\s-]?images"), F.lit(False))


def field(text: Column, name: str) -> Column:
    """What follows `name:` on its line; null if nothing."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i){name}[: \t]+([^\n\r|<]+)", 1)), F.lit(""))


def colours(text: Column, canon: Sequence[str] = COLOURS) -> Column:
    """Colours named behind RJ45 in capitals, possibly cut short: the first canonical colour that contains the token or that the token
    begins with, else the token itself; title case, each once."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"RJ[_-]?45[_-]([A-Za-z]+)"), F.lit(1))

    def named(t: Column) -> Column:
        low = F.lower(t)
        hit = F.filter(F.array(*map(F.lit, canon)), lambda c: c.contains(low) | low.startswith(c))
        return F.initcap(F.coalesce(F.get(hit, F.lit(0)), low))

    return F.array_distinct(F.transform(tokens, named))


def parts(text: Column) -> Column:
    """Trimmed parts between line ends, commas and semicolons, each also without what stands in brackets at its end."""
    own = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,;]+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_union(own, F.filter(F.transform(own, lambda p: F.trim(F.regexp_extract(p, r"^([^(]*)", 1))), lambda p: p != ""))


def first_tokens(name: Column, n: int = 4) -> Column:
    return F.slice(F.filter(F.split(name, r"[ _\-|]+"), lambda t: t != ""), 1, n)


def placeholder(value: Column, stop: Sequence[str], headers: Sequence[str]) -> Column:
    """The value, or null where it is a placeholder: a stop phrase, at most two words with a header word, or up to three words in capitals."""

    def judged(v: Column) -> Column:
        n = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
        low = F.lower(v)
        head = F.lit(False)
        for h in headers:
            head = head | low.contains(h)
        shouted = (v == F.upper(v)) & v.rlike("[A-Z]")
        return F.when((v == "") | low.isin(*stop) | ((n <= 2) & head) | (shouted & (n <= 3)), None).otherwise(v)

    return let(F.trim(F.coalesce(value, F.lit(""))), judged)


def bullets(text: Column) -> Column:
    """Sentences of a paragraph, each with its full stop and a bullet in front."""
    own = F.filter(F.transform(F.split(text, r"\.\s"), lambda s: F.btrim(s, F.lit(" ."))), lambda s: s != "")
    return F.array_join(F.transform(own, lambda s: F.concat(F.lit("- "), s, F.lit("."))), "\n")


def _scored(base: int):
    return lambda h: F.struct(h.alias("value"), (F.length(h) + base).alias("score"))


def models(text: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """(value, score) of every pattern's matches: plausible ones have four characters, a letter and a digit; score is the pattern's and the length."""
    found = F.array().cast("array<struct<value:string,score:int>>")
    for p, base in patterns:
        hits = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(f"({p})"), F.lit(1))
        found = F.concat(found, F.transform(hits, _scored(base)))
    return F.filter(found, lambda m: (F.length(m["value"]) >= 4) & m["value"].rlike("[A-Z]") & m["value"].rlike("[0-9]"))


def job_time(job_id: Column) -> Column:
    """The time in job_<milliseconds>_<hash>."""
    return F.timestamp_millis(F.nullif(F.regexp_extract(job_id, r"job_(\d+)_", 1), F.lit("")).cast("long"))
