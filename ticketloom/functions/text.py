"""Text rules as JVM-side column expressions: Unicode folding, masking, redaction, privacy tests."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# ICU and commons-text come with every Spark 4 distribution, so folding needs no Python worker.
_ICU = "com.ibm.icu.text.Normalizer"
_ICU_CASE = "com.ibm.icu.lang.UCharacter"
_HTML = "org.apache.commons.text.StringEscapeUtils"


def _static(owner: str, method: str, *args: Column) -> Column:
    return F.java_method(F.lit(owner), F.lit(method), *args)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: static calls are not shared between uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfc(text: Column) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), _static(_ICU, "compose", t, F.lit(False))))


def nfkc(text: Column) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), _static(_ICU, "compose", t, F.lit(True))))


def nfkd(text: Column) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), _static(_ICU, "decompose", t, F.lit(True))))


def casefold(text: Column) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), _static(_ICU_CASE, "foldCase", t, F.lit(True))))


def accent_fold(text: Column) -> Column:
    """NFKD, case folded, combining marks dropped."""
    return F.regexp_replace(casefold(nfkd(text)), r"\p{M}+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


# HTML5 names of Vietnamese letters and spaces that HTML4 tables lack.
_HTML5_NAMES = {
    "&abreve;": "ă",
    "&dstrok;": "đ",
    "&itilde;": "ĩ",
    "&utilde;": "ũ",
    "&tab;": "\t",
    "&newline;": "\n",
    "&period;": ".",
    "&comma;": ",",
}


def html_unescape(text: Column) -> Column:
    def decoded(t: Column) -> Column:
        closed = F.regexp_replace(t, r"&#(x[0-9a-fA-F]+|[0-9]+)(?![0-9a-fA-F;])", "&#$1;")
        named = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), _HTML5_NAMES.items(), closed)
        return F.when(t.contains("&"), _static(_HTML, "unescapeHtml4", named)).otherwise(t)

    return let(text, decoded)


def strip_tags(text: Column) -> Column:
    tag = r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<[!?][^>]*>"
    return let(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, tag, "")).otherwise(t))


def normalize_transfer_text(text: Column) -> Column:
    """NFKC, case folded, entities decoded, tags and all white space dropped."""
    visible = html_unescape(strip_tags(html_unescape(casefold(nfkc(text)))))
    return F.regexp_replace(visible, r"(?U)\s+", "")


def normalized_template(text: str) -> str:
    """The same normal form of a constant, computed once while the plan is built."""
    folded = html.unescape(unicodedata.normalize("NFKC", text).casefold())
    return "".join(html.unescape(re.sub(r"<[^>]*>", "", folded)).split())


# ---- privacy predicates -------------------------------------------------------------------

# Patterns of identifiers and of safe names.
PHONE = r"(?U)(?:^|\D)(?:0|84|\+84)[0-9]{8,10}(?:$|\D)"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
EMAIL = r"(?U)[^\s@]+@[^\s@]+\.[^\s@]+"
URL = r"(?iU)(?:https?://|www\.)\S+"
CONTROL = r"\p{C}"
LONG_NUMBER = r"(?U)\d{6}"
PERSON_NAME = r"(?iuU)^\s*(?:%s)\s+(?:%s)\s+\p{L}{1,32}\s*$" % ("|".join(K.FAMILY_NAMES), "|".join(K.NAME_MIDDLES))
TICKET_ID = r"^[1-9][0-9]{0,19}$"
INTENT = r"^[a-z0-9_-]{1,64}$"
SKILL = r"^[a-z0-9_-]{1,64}$"
TPE_TOKEN = r"^-?[0-9]{1,6}$"


def _any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def safe_string(text: Column) -> Column:
    """Trimmed NFC text when it is short and carries no identifier, else null."""

    def checked(cleaned: Column) -> Column:
        unsafe = _any_match(cleaned, (PHONE, UUID, EMAIL, URL, CONTROL, LONG_NUMBER, PERSON_NAME))
        return F.when((cleaned != "") & ~unsafe, cleaned)

    return let(F.when(F.length(text) <= 256, nfc(strip(text))), checked)


def safe_dimension(text: Column) -> Column:
    return F.coalesce(safe_string(text), F.lit(K.MISSING))


def is_safe_ticket_id(text: Column) -> Column:
    return F.coalesce(text.rlike(TICKET_ID) & ~text.rlike(PHONE), F.lit(False))


def is_safe_intent(text: Column) -> Column:
    safe = text.rlike(INTENT) & ~_any_match(text, (PHONE, UUID, EMAIL, URL, LONG_NUMBER))
    return F.coalesce(safe, F.lit(False))


def safe_skill(text: Column, prefix: str = K.SKILL_PREFIX) -> Column:
    """Skill name without its prefix; null when it is not a plain, non-identifying name."""
    name = F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)
    phone = r"^(?:0|84)[0-9]{8,10}$"
    uuid = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return F.when(name.rlike(SKILL) & ~_any_match(name, (phone, uuid, r"[0-9]{6}")), name)


def has_phone_digits(text: Column) -> Column:
    """Phone number hidden among other characters, full-width digits included."""
    return F.regexp_replace(nfkc(text), r"(?U)\D+", "").rlike(r"(?:0|84)[0-9]{8,10}")


#: The decimal digits of every script, and the same digits in ASCII.
_DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def fold_digits(text: Column) -> Column:
    """Decimal digits of all scripts as ASCII digits; texts without such digits are left alone."""
    return let(text, lambda t: F.when(t.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(t, _DIGITS, _ASCII_DIGITS)).otherwise(t))


def has_private_identifier(text: Column) -> Column:
    uuid = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"

    def found(plain: Column) -> Column:
        return F.regexp_replace(plain, r"(?U)\D+", "").rlike(r"(?:0|84)[0-9]{8,10}") | plain.rlike(uuid)

    return F.coalesce(let(fold_digits(F.regexp_replace(nfkc(text), r"[\p{Cf}\p{M}]+", "")), found), F.lit(False))


def looks_like_person(name: Column, extra_tokens: tuple[str, ...] = ()) -> Column:
    """Two to six alphabetic words, none of them a service word."""

    def judged(cleaned: Column) -> Column:
        words = F.split(cleaned, r"(?U)\s+")
        alphabetic = F.forall(words, lambda w: F.replace(w, F.lit("-"), F.lit("")).rlike(r"^\p{L}+$"))

        def is_service(folded: Column) -> Column:
            tokens = F.split(F.replace(folded, F.lit("-"), F.lit(" ")), r"(?U)\s+")
            named = F.arrays_overlap(tokens, F.lit(list(K.SERVICE_TOKENS + extra_tokens)))
            return reduce(lambda a, b: a | b, [folded.contains(p) for p in K.SERVICE_PHRASES], named)

        return F.size(words).between(2, 6) & alphabetic & ~let(accent_fold(cleaned), is_service)

    return F.coalesce(let(strip(nfkc(name)), judged), F.lit(False))


# ---- masking ------------------------------------------------------------------------------


def mask_patterns(text: Column) -> Column:
    """URLs, e-mails, separated card numbers and 9-20 digit runs replaced, then cut to size."""
    rules = (  # fixed values
        r"(?iuU)\b(?:https?://|www\.)[^\s<>\"']+",
        r"(?iuU)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,63}\b",
        # Unseparated card numbers are 13-19 digit runs, which the last rule masks as well.
        r"(?U)(?<!\d)(?<!\d[ -])(?:\d[ -]?){12,18}\d(?![ -]?\d)",
        r"(?U)(?<!\d)\d{9,20}(?!\d)",
    )
    masked = reduce(lambda c, p: F.regexp_replace(c, p, K.PII), rules, text)
    return F.substring(masked, 1, K.MASK_LENGTH)


def mask_known(text: Column, values: Column) -> Column:
    """Exact known values replaced, longest first, then by text order."""
    kept = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    ordered = F.array_sort(F.transform(kept, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<n:int,v:string>>")), text,
                       lambda acc, item: F.replace(acc, item["v"], F.lit(K.PII)))


def mask_text(text: Column, values: Column | None = None) -> Column:
    return mask_patterns(text if values is None else mask_known(text, values))


def mask_digit_runs(text: Column) -> Column:
    """Every digit of a run of nine or more becomes a star."""
    inside = "|".join(f"(?<=[0-9]{{{i}}})[0-9](?=[0-9]{{{8 - i}}})" for i in range(9))
    return F.regexp_replace(text, inside, "*")


# What a survey comment must not show, in the order of the rules.
_COMMENT_RULES = (
    r"(?U)[^\s@]+@[^\s@]+\.[^\s@]+",
    r"(?iuU)(?:https?://|www\.)\S+"
    r"|(?<![\w])(?:(?:mailto|tel|sms|data|javascript|geo|urn):\S+|[a-z][a-z0-9+.-]*:(?://\S+|[^\s:/?#]+[/?#]\S*))"
    r"|(?<![\w@])(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,63}(?::\d{1,5})?(?:[/?#]\S*)?"
    r"|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?:[/?#]\S*)?"
    r"|\[[0-9a-f:.%]+\](?::\d{1,5})?(?:[/?#]\S*)?"
    r"|(?<![\w:])(?:[0-9a-f]{0,4}:)*[0-9a-f]{0,4}::(?:[0-9a-f]{0,4}:)*[0-9a-f]{0,4}(?:[/?#]\S*)?"
    r"|(?<![\w:])(?:[0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}(?:[/?#]\S*)?",
    r"(?U)(?<!\d)(?:\+?84|0)(?:[\s._-]*\d){8,10}(?!\d)",
    r"(?U)(?<!\d)(?:\d[\s._-]*){6,}(?!\d)",
    r"(?U)\b(?=[A-Za-z0-9_-]{8,}\b)(?=[A-Za-z0-9_-]*[A-Za-z])(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]+\b",
)


#: What a text must hold for each rule to find anything: cheap to test, so most rules are skipped.
_COMMENT_NEEDS = ("@", r"\[|[.:]\S", r"\p{Nd}", r"\p{Nd}", r"\p{Nd}")


def _where_needed(rule: str, needed: str):
    return lambda c: F.when(c.rlike(needed), F.regexp_replace(c, rule, K.REDACTED)).otherwise(c)


def redact_comment(text: Column) -> Column:
    """Survey comment without contacts, numbers and personal names; null when nothing is left.

    The output is cut at 200 characters. A kept word takes two characters and a replaced name
    seven for at most three words, so the first 120 words decide the whole output.
    """
    cleaned = strip(text)
    for rule, needed in zip(_COMMENT_RULES, _COMMENT_NEEDS):
        cleaned = let(cleaned, _where_needed(rule, needed))
    # one more than can be shown, so that the rest of a long text is not cut into words
    words = F.filter(F.slice(F.split(cleaned, r"(?U)\s+", 121), 1, 120), lambda w: w != "")
    edges = r"^[.,:;!?()\[\]{}\"']+|[.,:;!?()\[\]{}\"']+$"
    pairs = F.transform(words, lambda w: F.struct(w.alias("w"), F.regexp_replace(w, edges, "").alias("t")))
    candidate = let(pairs, _without_names)
    return let(strip(F.substring(candidate, 1, K.COMMENT_LENGTH)),
               lambda c: F.when(c != "", F.coalesce(safe_string(c), F.lit(K.REDACTED))))


def _without_names(words: Column) -> Column:
    """Words joined again with personal names replaced, walking from left to right."""
    names, middles = F.lit(list(K.FAMILY_NAMES)), F.lit(list(K.NAME_MIDDLES))
    ambiguous = F.lit(["do", "ho", "le", "ly", "vo", "vu", "dang"])

    def folded(i: Column) -> Column:
        return F.coalesce(F.lower(F.get(words, i)["t"]), F.lit(""))

    def name_length(word: Column, i: Column) -> Column:
        here, after, before = F.lower(word["t"]), folded(i + 1), folded(i - 1)
        common = (here.isin("lý", "ly") & (after == "do")) | ((here == "hồ") & (after == "sơ"))
        common = common | ((here == "ho") & (after == "so"))
        process = here.isin("lý", "ly") & before.isin("xử", "xu")
        middle = F.array_contains(middles, after)
        lower_ascii = F.array_contains(ambiguous, here) & ~word["t"].rlike(r"^\p{Lu}") & ~middle
        hit = F.array_contains(names, here) & ~common & ~process & ~lower_ascii & (i + 1 < F.size(words))
        return F.when(hit, F.when(middle & (i + 2 < F.size(words)), F.lit(3)).otherwise(F.lit(2))).otherwise(F.lit(0))

    steps = F.transform(words, lambda w, i: F.struct(w["w"].alias("w"), i.alias("i"), name_length(w, i).alias("n")))
    start = F.struct(F.lit(0).alias("next"), F.lit("").alias("out"))

    def walk(acc: Column, step: Column) -> Column:
        word = F.when(step["n"] > 0, F.lit(K.REDACTED)).otherwise(step["w"])
        joined = F.when(acc["out"] == "", word).otherwise(F.concat(acc["out"], F.lit(" "), word))
        moved = F.struct((step["i"] + F.greatest(step["n"], F.lit(1))).alias("next"), joined.alias("out"))
        return F.when(step["i"] < acc["next"], acc).otherwise(moved)

    return F.aggregate(steps, start, walk, lambda acc: acc["out"])


def strip_title_suffix(title: Column) -> Column:
    suffix = r"(?iuU)\s*\(\s*Mã giao dịch\s*:[^)]*\)\s*-\s*\(\s*Ticket id\s*:[^)]*\)\s*$"
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), suffix, ""))


def natural_key(text: Column) -> Column:
    """Sort key: numbers of any length compare by value and before letters; a number is tagged with its length."""
    folded = casefold(nfkc(text))
    parts = F.regexp_extract_all(folded, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def keyed(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(F.concat(F.lit("1"), p))

    return F.transform(parts, keyed)


def uuid5_url(name: Column) -> Column:
    """uuid5 in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.lit(["8", "9", "a", "b"]), (nibble % 4) + 1)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def response_key(source_id: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(source_id.cast("string"), 256))
