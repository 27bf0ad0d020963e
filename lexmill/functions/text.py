"""Text functions as Column expressions; every one stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters with marks and their plain letters.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿĄąĆćĘęŁłŃńŚśŹźŻż"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyyAaCcEeLlNnSsZzZz"
# The Polish letters folded for alias lookup.
POLISH, POLISH_PLAIN = "ąćęłńóśźż", "acelnoszz"
# Function words by which English and French are told apart.
EN_WORDS = ("the", "of", "and", "to", "in", "shall", "that", "by", "or", "is")
FR_WORDS = ("le", "la", "les", "de", "des", "et", "du", "que", "dans", "est")
# Entities that are unescaped when tags are stripped.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

WS = r"[ \t\n\r\f]+"


def clean(c: Column) -> Column:
    """Single spaces, no blanks at the ends."""
    return F.trim(F.regexp_replace(c, WS, " "))


def snippet(c: Column, n: int) -> Column:
    """Cleaned text cut to ``n`` characters, with an ellipsis if anything was cut."""
    t = clean(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def role(c: Column) -> Column:
    """Cleaned text without punctuation at the ends."""
    return F.regexp_replace(clean(c), r"^[ .,;:]+|[ .,;:]+$", "")


def fold(c: Column) -> Column:
    """Plain letters for marked ones, ligatures written out."""
    return F.translate(F.replace(F.replace(F.replace(c, F.lit("Œ"), F.lit("OE")), F.lit("œ"), F.lit("oe")), F.lit("ß"), F.lit("ss")), MARKED, PLAIN)


def fold_polish(c: Column) -> Column:
    return F.translate(F.lower(c), POLISH, POLISH_PLAIN)


def title_key(c: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))


def doi(c: Column) -> Column:
    """A DOI without resolver, prefix or case; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:[ ]*)", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/[^ ]+$"), bare)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_filename(c: Column) -> Column:
    """Letters of any script, digits, dot, dash and underscore; anything else becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]+", "_")


def identifier(c: Column) -> Column:
    """Trimmed, upper case, without separators."""
    return F.upper(F.regexp_replace(F.trim(c), r"[ ./_-]+", ""))


def strip_html(c: Column) -> Column:
    """Text of an HTML fragment: scripts, styles and tags dropped, common entities unescaped."""
    t = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return clean(t)


def _chain(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# The escapes of each output format, in the order they must run.
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
ICS_ESCAPES = (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n"))
MD_ESCAPES = (("|", "\\|"), ("\n", " "))
LATEX_ESCAPES = (("\\", "\x01"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"), ("\x01", "\\textbackslash{}"))


def escape(c: Column, style: str) -> Column:
    """Text made safe for ``xml``, ``ics``, ``md`` or ``latex``."""
    return _chain(c, {"xml": XML_ESCAPES, "ics": ICS_ESCAPES, "md": MD_ESCAPES, "latex": LATEX_ESCAPES}[style])


def column_letters(n: Column) -> Column:
    """Spreadsheet column letters of a number from 1; fourteen reach beyond any long."""
    whole = lambda k: F.call_function("div", k, F.lit(26).cast("long"))
    step = lambda acc: F.struct(whole(acc["m"] - 1).alias("m"), F.concat(F.chr(((acc["m"] - 1) % 26 + 65).cast("int")), acc["s"]).alias("s"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(n.cast("long").alias("m"), F.lit("").alias("s")), lambda acc, _: F.when(acc["m"] > 0, step(acc)).otherwise(acc), lambda acc: acc["s"])
    return F.when(n > 0, found)


def column_index(c: Column) -> Column:
    """Number of spreadsheet column letters."""
    return F.aggregate(F.split(F.upper(c), ""), F.lit(0).cast("long"), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + (F.ascii(x) - 64)))


def keep_case(like: Column, word: Column) -> Column:
    """``word`` with the initial's case of ``like``."""
    first = F.substring(like, 1, 1)
    return F.when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20))).otherwise(word)


def words(c: Column) -> Column:
    """Lower-case words of Latin letters, marks folded."""
    return F.filter(F.split(F.lower(fold(c)), "[^a-z]+"), lambda w: w != "")


def language(c: Column, least: int = 3) -> Column:
    """``en`` or ``fr`` by function words, at least ``least`` of them; ``und`` on a tie or too few."""
    count = lambda bag: F.size(F.filter(words(c), lambda w: w.isin(*bag)))
    en, fr = count(EN_WORDS), count(FR_WORDS)
    return F.when((en >= least) & (en > fr), "en").when((fr >= least) & (fr > en), "fr").otherwise("und")


def quote_balance(c: Column) -> Column:
    """Opening less closing angle quotation marks."""
    count = lambda q: F.length(c) - F.length(F.replace(c, F.lit(q), F.lit("")))
    return count("«") - count("»")


def ratio_band(source: Column, target: Column, least: int = 150) -> Column:
    """``block`` under 0.3 of the source's length, ``warn`` under 0.6, for sources of at least ``least`` characters."""
    ratio = target / source
    return F.when(source < least, "short").when(ratio < 0.3, "block").when(ratio < 0.6, "warn").otherwise("ok")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def page_ranges(c: Column) -> Column:
    """Sorted distinct numbers of a list such as ``1-3,5``; parts that are no range are left out."""
    parts = F.split(F.regexp_replace(c, " ", ""), ",")
    bound = lambda x, k: F.try_element_at(F.split(x, "-"), F.lit(k)).try_cast("int")
    spread = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.array(x.cast("int"))).when(x.rlike("^[0-9]+-[0-9]+$") & (bound(x, 1) <= bound(x, 2)), F.sequence(bound(x, 1), bound(x, 2))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(spread)))


def money(c: Column) -> Column:
    """Amounts after a currency sign, as decimals, in order."""
    found = F.regexp_extract_all(c, F.lit(r"[$£€] ?([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})"), 1)
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("decimal(18,2)"))


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])
