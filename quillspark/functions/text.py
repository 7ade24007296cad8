"""Scalar text rules as Column expressions: no Python at run time, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: white space as a Unicode-aware regular expression reads it
WS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: fixed values: sentence ends, opening quotes, dashes, bracket pairs
ENDS = ".!?…"
QUOTE_OPENERS = "“\"«‘’”"
DASHES = "—–"
#: fixed values: typographic marks and their plain forms for comparison
PLAIN = {"“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "‘": "'", "’": "'"}
LONG_PLAIN = {"—": "--", "–": "-", "…": "..."}
#: fixed values: words that name a part of a book
STRUCTURE_WORDS = ("chapter", "part", "book", "prologue", "epilogue", "interlude", "foreword", "preface", "afterword")
#: fixed values: first and second person pronouns that are no entity
PERSONAL = ("i", "me", "my", "myself", "we", "us", "our", "ours", "you", "your", "yours", "yourself")
#: the namespace of segment ids: uuid5 of the URL namespace and this name
SEGMENT_NAMESPACE_NAME = "quillspark:segment:v1"


def c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c(col), f"^{WS}+|{WS}+$", "")


def collapse_blanks(col: Column | str) -> Column:
    """Runs of blanks, tabs and no-break spaces to one blank; stripped."""
    return strip(F.regexp_replace(c(col), r"[ \t\u00a0]+", " "))


def collapse(col: Column | str) -> Column:
    """Runs of any white space to one blank; stripped."""
    return strip(F.regexp_replace(c(col), f"{WS}+", " "))


def words(col: Column | str) -> Column:
    """White-space words."""
    return F.filter(F.split(c(col), f"{WS}+"), lambda w: w != "")


def line_key(col: Column | str) -> Column:
    """Key by which lines repeat: digits to #, blanks collapsed."""
    return collapse_blanks(F.regexp_replace(c(col), r"\p{Nd}", "#"))


def sentences(col: Column | str) -> Column:
    """Split after sentence ends followed by white space; stripped, none empty."""
    return F.filter(F.transform(F.split(c(col), f"(?<=[{ENDS}]){WS}+"), strip), lambda s: s != "")


def estimated_tokens(col: Column | str) -> Column:
    """Tokens by estimate: a run of white space, marks or word characters is one for every three characters begun."""
    runs = F.regexp_extract_all(F.coalesce(c(col), F.lit("")), F.lit(rf"({WS}+|[^\s\u00a0\p{{L}}\p{{N}}_]+|[\p{{L}}\p{{N}}_]+)"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(1), F.ceil(F.length(w) / 3)))


def is_scene_break(col: Column | str) -> Column:
    return c(col).rlike(r"^[*#•.\s\u00a0~\-—–]{3,}$")


def paragraph_kind(col: Column | str) -> Column:
    """scene_break, epigraph, letter, dialogue, quotation or paragraph; the first rule that fits."""
    t = strip(F.coalesce(c(col), F.lit("")))
    first = F.substring(t, 1, 1)
    opening = F.array(*[F.lit(x) for x in QUOTE_OPENERS + "'" + DASHES])
    return (
        F.when(t == "", "paragraph")
        .when(is_scene_break(t), "scene_break")
        .when(t.rlike(r"(?i)^[“\"']?(?:An old |Ancient |Old )?(?:saying|proverb|epigraph)(?![\p{L}\p{N}_])"), "epigraph")
        .when(t.rlike(r"(?m)^(?:Dear|My dear|Dearest|Darling|My own)\s+[A-Z]") | t.rlike(r"(?:Yours|Sincerely|Farewell|Ever yours|With love)[,\s]"), "letter")
        .when(F.array_contains(opening, first), "dialogue")
        .when(t.startswith("> "), "quotation")
        .otherwise("paragraph")
    )


def ends_terminal(col: Column | str) -> Column:
    """Ends a sentence, closing quotes and brackets aside."""
    return F.regexp_replace(c(col), f"{WS}+$", "").rlike(r"[.!?…][\"'”’»)\]}*]*$")


def ends_soft(col: Column | str) -> Column:
    return F.regexp_replace(c(col), f"{WS}+$", "").rlike("[,:;—–]$")


def has_markup(col: Column | str) -> Column:
    return c(col).rlike(r"\[\[[^\]]+\]\]|\{\{[^}]+\}\}|<[a-z/][^>]*>")


def bracket_balance(col: Column | str) -> Column:
    """Open less closed brackets; a character after a backslash counts as none."""
    t = F.regexp_replace(c(col), r"(?s)\\.", "")
    return (F.regexp_count(t, F.lit(r"[(\[{«]")) - F.regexp_count(t, F.lit(r"[)\]}»]"))).cast("long")


def plain_quotes(col: Column | str) -> Column:
    return F.translate(c(col), "".join(PLAIN), "".join(PLAIN.values()))


def for_compare(col: Column | str) -> Column:
    """Quotes, dashes and ellipses plain, lower case, white space collapsed."""
    t = plain_quotes(F.coalesce(c(col), F.lit("")))
    for mark, plain in LONG_PLAIN.items():
        t = F.replace(t, F.lit(mark), F.lit(plain))
    return collapse(F.lower(t))


def mostly_digits(col: Column | str) -> Column:
    """Over three tenths of letters and digits are digits."""
    letters, digits = (F.regexp_count(F.coalesce(c(col), F.lit("")), F.lit(p)) for p in (r"\p{L}", r"[\p{Nd}\p{No}]"))
    return (digits > 0) & (digits / F.greatest(F.lit(1), letters + digits) > 0.3)


def copy_allowed(col: Column | str) -> Column:
    """A source that may stay as it is: under four words, or mostly digits."""
    t = for_compare(col)
    return (t == "") | (F.size(words(t)) < 4) | mostly_digits(t)


def head_tail(col: Column | str) -> Column:
    """First and last sentence by full stops; the whole text where there are fewer than two."""
    t = strip(F.coalesce(c(col), F.lit("")))
    parts = F.filter(F.transform(F.split(t, r"\."), strip), lambda s: s != "")
    tail = F.concat(F.element_at(parts, -1), F.when(t.endswith("."), F.lit(".")).otherwise(F.lit("")))
    return F.when(F.size(parts) < 2, t).otherwise(F.concat(F.element_at(parts, 1), F.lit(". "), tail))


def control_tokens(col: Column | str) -> Column:
    return F.regexp_extract_all(c(col), F.lit(r"(\[\[[A-Z_]+:[^\]]*\]\])"), F.lit(1))


def upper_ratio(col: Column | str) -> Column:
    letters = F.regexp_count(c(col), F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(c(col), F.lit(r"\p{Lu}")) / letters)


def _bare_words(col: Column, marks: str) -> Column:
    return F.transform(words(collapse_blanks(col)), lambda w: F.lower(F.btrim(w, F.lit(marks))))


def is_structural(col: Column | str) -> Column:
    """Names a part of a book."""
    return F.arrays_overlap(_bare_words(c(col), ".,:;!?\"'()"), F.array(*[F.lit(w) for w in STRUCTURE_WORDS]))


def has_roman(col: Column | str) -> Column:
    return F.exists(_bare_words(c(col), ".,:;()"), lambda w: w.rlike("^[ivxlcdm]+$"))


def lexical_score(col: Column | str) -> Column:
    """Strength of a heading by its words."""
    t = F.lower(collapse_blanks(col))
    head = F.when(F.instr(t, ":") > 0, strip(F.substring_index(t, ":", 1))).otherwise(t)
    word = r"(?![\p{L}\p{N}_])"
    fixed = [rf"^(chapter|ch\.)\s+([0-9]+|[ivxlcdm]+){word}", rf"^(part|book)\s+([0-9]+|[ivxlcdm]+|[a-z]+){word}", rf"^(prologue|epilogue|interlude|foreword|preface|afterword){word}"]
    hit = t.rlike(fixed[0]) | t.rlike(fixed[1]) | t.rlike(fixed[2])
    return F.when(hit, 0.95).when(is_structural(head) & (F.length(t) <= 60), 0.72).otherwise(0.0)


def typographic_score(col: Column | str, size_ratio: Column, bold: Column) -> Column:
    """Strength of a heading by its looks; size_ratio: its font to the body's, 0 if unknown."""
    t = collapse_blanks(col)
    upper = upper_ratio(t)
    terms = [
        F.when(size_ratio >= 1.15, 0.35), F.when(size_ratio >= 1.5, 0.1), F.when(bold >= 0.5, 0.15),
        F.when(upper >= 0.8, 0.15).when(upper >= 0.5, 0.08), F.when(F.length(t) <= 60, 0.1), F.when(has_roman(t), 0.1), F.when(is_structural(t), 0.1),
    ]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in terms), F.lit(0.0))
    return F.when(t == "", 0.0).otherwise(F.least(total, F.lit(1.0)))


def normal_title(col: Column | str) -> Column:
    """First word capitalised, the rest as it is."""
    t = collapse_blanks(col)
    head, at = F.substring_index(t, " ", 1), F.instr(t, " ")
    head = F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substr(head, F.lit(2))))
    return F.when(at == 0, head).otherwise(F.concat(head, F.lit(" "), F.substr(t, at + 1)))


def node_kind(col: Column | str) -> Column:
    low = F.lower(collapse_blanks(col))
    return F.when(low.startswith("epilogue") | low.startswith("afterword"), "back_matter").when(low.startswith("part") | low.startswith("book"), "part").otherwise("chapter")


def is_dateline(col: Column | str) -> Column:
    return collapse_blanks(col).rlike(r"^[A-Z][A-Za-z .'\-]{1,40},\s*(?:the\s+)?(?:\d{1,2}\s+)?[A-Z][a-z]+\s+\d{1,4}\.?$")


def name_key(col: Column | str) -> Column:
    """Name for matching: lower case, without article, possessive and marks."""
    t = F.regexp_replace(F.lower(strip(col)), r"^(the|a|an)\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"'s\s*$", ""), "[^0-9a-zÀ-ɏ]+", " ")
    return collapse(t)


def personal_only(col: Column | str) -> Column:
    """Holds nothing but first and second person pronouns."""
    w = words(F.lower(c(col)))
    return (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*PERSONAL))


def memory_key(col: Column | str) -> Column:
    """Source for exact matching: lower case, tags and marks to blanks."""
    t = F.regexp_replace(F.lower(F.coalesce(c(col), F.lit(""))), r"\[\[.*?\]\]", " ")
    return collapse(F.regexp_replace(t, r"[^a-z0-9\sà-ÿ]", " "))


def memory_tokens(col: Column | str) -> Column:
    """The words of memory_key(), each once. Its marks and white space bound them as they are, so neither is replaced before."""
    x = F.lower(F.coalesce(c(col), F.lit("")))
    x = F.when(x.contains("[["), F.regexp_replace(x, r"\[\[.*?\]\]", " ")).otherwise(x)
    return F.array_distinct(F.regexp_extract_all(x, F.lit("[a-zà-ÿ0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def character_grams(col: Column | str) -> Column:
    """The token, its pairs and its triples of characters, each once."""
    t = F.lower(c(col))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(t) - n + 1)
        return F.when(F.length(t) >= n, F.transform(starts, lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = [runs(2), runs(3)]
    return F.array_distinct(F.concat(F.array(t), *parts))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is missing, empty, zero or of another length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(c(a)) == F.size(c(b))) & (norms > 0)
    return F.when(fine, dot(a, b) / norms).otherwise(0.0)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


#: fixed values: what must survive a translation
URL = r"(?i)https?://[^\s]+"
ISO_DATE = r"(?<![\p{L}\p{N}_])\d{4}-\d{2}-\d{2}(?![\p{L}\p{N}_])"
SLASH_DATE = r"(?<![\p{L}\p{N}_])\d{1,2}/\d{1,2}/\d{2,4}(?![\p{L}\p{N}_])"
QUANTITY = r"(?i)(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)?\s*(?:%|kg|g|mg|km|ml|°C|°F|USD|EUR|GBP|yr|yrs|years?|months?|days?|hours?|mins?|sec|secs|s)(?![\p{L}\p{N}_])"
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)?(?![\p{L}\p{N}_])"
PLACEHOLDERS = (r"\{[^}]+\}", r"<[^/>\s]+(?:\s[^/>]*[^/])?/?>", r"\$\{[^}\+]+\}")


def every(col: Column | str, *patterns: str) -> Column:
    """All matches of each pattern in turn."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(c(col), F.lit("")), F.lit(f"({p})"), F.lit(1)) for p in patterns])


def invariants(col: Column | str) -> Column:
    return every(col, ISO_DATE, SLASH_DATE, URL, NUMBER)


#: fixed values: marks of the languages that text is translated to: words, other words, letters
MARKERS = {
    "it": ("che|non|per|con|una|uno|il|la|le|gli|del|della|dello|degli|delle|questo|questa|quello|quella|sono|essere|stato|stata|stati|state|aveva|avevo|avevano|nella|nello|nelli|alla|dalla|sulla|piu|più|gia|già|cosi|così|anche|loro|noi|voi|ma|come|dove|quando|se|si|ha|hanno|ho|hai|sua|suo|miei|tuoi|suoi|questi|queste|quelli|quelle|molto|troppo|poi|invece|davvero|forse", "i", "àèéìíòóù"),
    "es": ("el|los|las|que|del|un|una|unos|unas|es|son|estaba|estaban|pero|para|por|como|cuando|donde|este|esta|esto|ese|esa|eso|su|sus|muy|mas|más|tambien|también|ya|se|ha|han|he|era|fue|ser|estar|todo|todos|toda|todas|cada|entre|sobre|tras|desde|hasta|segun|según|sin|mismo|misma|otros|otras|otro|otra|nosotros|ustedes|ellos|ellas|hay|está|con|ni|lo|al|mientras|entonces|asi|así", "", "áéíóúñü¿¡"),
    "fr": ("les|des|du|une|est|sont|etait|était|que|qui|mais|avec|pour|par|comme|quand|ce|cet|cette|ces|son|sa|ses|leur|leurs|tres|très|plus|aussi|deja|déjà|dans|sur|sous|sans|meme|même|tout|tous|toute|toutes|chaque|entre|elle|elles|ils|nous|vous|je|ne|pas|etre|être|avoir|ont|c'est|qu'il|qu'elle|d'un|d'une|aux|au|alors|apres|après", "", "àâçéèêëîïôùûüÿœ"),
    "de": ("der|die|das|den|dem|des|ein|eine|einen|einem|einer|und|ist|sind|war|waren|dass|nicht|mit|für|auf|von|zu|zum|zur|wie|wann|dieser|diese|dieses|sein|seine|ihre|sehr|mehr|auch|schon|wenn|sich|hat|haben|hatte|aber|oder|doch|nur|noch|alle|jeder|jede|zwischen|unter|nach|vor|beim|durch|ohne|gegen|kein|keine|man|wird|werden|wurde|kann|muss", "", "äöüß"),
    "pt": ("os|as|um|uma|uns|umas|do|da|dos|das|não|nao|estava|mas|para|por|como|quando|onde|este|esta|esse|essa|isso|seu|sua|seus|suas|muito|muita|mais|tambem|também|ja|já|tem|têm|foi|ser|estar|tudo|todos|toda|todas|cada|entre|sobre|sem|mesmo|mesma|outros|outras|outro|outra|nos|vocês|eles|elas|com|no|na|nas|pelo|pela|entao|então|depois", "", "ãõáéíóúâêôç"),
}


def has_markers(col: Column | str, lang: str) -> Column:
    """Looks like a language: one of its letters, or two or more of its frequent words."""
    frequent, plain, letters = MARKERS[lang]
    low = F.lower(F.coalesce(c(col), F.lit("")))
    n = F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({frequent})(?![\p{{L}}\p{{N}}_])"))
    if plain:
        n = n + F.regexp_count(F.coalesce(c(col), F.lit("")), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({plain})(?![\p{{L}}\p{{N}}_])"))
    return F.coalesce(c(col), F.lit("")).rlike(f"[{letters}]") | (n >= 2)


def heading_level(ratio: Column, bold: Column, upper: Column) -> Column:
    """1 to 3 by size against the body's, 4 for bold or upper case alone, null for none."""
    return F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when(ratio >= 1.15, 3).when((bold >= 0.5) | (upper >= 0.8), 4)


def context_window(col: Column | str) -> Column:
    """Tokens that a model's name promises, such as 128K or 1M; null for none."""
    low = F.lower(c(col))
    n = F.regexp_extract(low, r"(?<![a-z0-9])(\d+)\s*([km])(?![a-z0-9])", 1).try_cast("bigint")
    return n * F.when(F.regexp_extract(low, r"(?<![a-z0-9])(\d+)\s*([km])(?![a-z0-9])", 2) == "m", 1024 * 1024).otherwise(1024)


def assembled(lines: Column) -> Column:
    """Lines of a paragraph as one text: a line that ends in a hyphen is joined to the next without a blank."""
    return F.aggregate(lines, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))
