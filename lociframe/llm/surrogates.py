"""PII: keyed surrogates of the same type, in DataFrame functions only.

One pattern finds mail addresses, secrets after a telling name, IP addresses, account, card, social
security and phone numbers, and names after a form of address. Every entity has a canonical form
(mail in lower case, numbers without their separators, names in lower case), so spellings of one
thing get one surrogate, in every document and after every run with the same key. Surrogates come
from keyed SHA-256: digits stay digits and letters letters of their case, separators, country codes
and card check sums stay as they are; names are made of syllables of the same script and follow the
gender of the form of address; a name has one surrogate under all titles, as given and as family
name.

Collision check: candidates of all distinct canonical forms meet in a grouped minimum. A candidate
that two forms share goes to the smaller one; it is refused to all if it is taken, or if the corpus
has it as an entity of that type. Refused forms try again with the next attempt number until none is
left, so distinct entities stay distinct. The first attempts keep the form; later ones have more
characters or a wider block of addresses, so a small or full pool ends in longer surrogates. Only these short rows move, and once the texts that have
entities; texts without any never leave their task. A hot entity is one row on its side of the
joins, so adaptive execution splits it. The patterns run only over texts that pass a cheap test,
which every text with an entity passes.

Defined results: null and empty texts and texts without entities stay as they are; rows with equal
id and text are replaced alike; null ids are ids; an input column named like a result column is
replaced; empty tables give empty results. A name is all parts that follow a form of address:
names, initials and, kept as they are, particles. The names found so are replaced wherever they
stand in the same text as a whole word with a capital; bare mentions in other texts stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import fresh, settle, table

STAY = 8  # attempts within the form of the original; each further one widens the pool
KEY = "surrogate-key-1"  # a production run passes its own

# fixed values: forms of address by the gender they tell
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Signor|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Señorita|Signora|г-жа|госпожа"
NEUTRAL = "Dr|Prof"
_TITLE = f"(?:{MALE}|{FEMALE}|{NEUTRAL})"
_GAP = r"[ \u00a0]{1,2}"
_WORD = r"(?:\p{Ll}{1,3}['’-])?\p{Lu}(?:[\p{L}\p{M}]|['’-](?!s\b)(?=\p{L}))*+"  # without the 's of a genitive
_PARTICLES = f"(?:(?:von|vom|van|zu|zur|der|den|de|del|della|la|le|da|das|dos|du|di|ter|ten|bin|ibn|al|el|af|av|фон|де){_GAP})*"
_PART = rf"(?!{_TITLE}\b)(?:\p{{Lu}}\.|{_WORD})"
#: all parts of a name: initials, names and the particles between them
_RUN = rf"{_PARTICLES}{_PART}(?:(?:{_GAP}|(?<=\.)-?){_PARTICLES}{_PART})*+"
_BOUND = r"[\p{L}\p{M}\p{N}]"
#: kind, pattern; the first that fits at a place counts
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@(?:[\p{L}\p{M}\p{N}-]{1,63}\.){1,126}(?:xn--[A-Za-z0-9-]{1,59}|\p{L}[\p{L}\p{M}]{1,62})(?![\p{L}\p{N}_-])"),
    # the cheap look ahead comes before the long look behind
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{16})(?i:(?<=(?:token|secret|passwd|password|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?))[A-Za-z0-9_+/-]{16,}"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+\d{1,3} ?\(\d{1,4}\) ?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?<sep>[ .-]?)\d{2,4}(?:\k<sep>\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
     r"|(?<![\w.+(/-])\d{3}(?<gap>[ .-])\d{3}\k<gap>\d{4}(?![\w-])|(?<![\w.+(/-])(?=0\d(?:[ /-]?\d){7,10}(?![\w/-]))0\d{1,4}[ /-]\d{3,9}(?:[ -]\d{2,5})*(?![\w/-])"),
    ("name", rf"(?<=[ \u00a0])(?=\p{{L}})(?<=\b{_TITLE}\.?{_GAP}){_RUN}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
NAMED = PATTERNS[-1][1]
# syllables for surrogate names: script, first parts, inner parts, endings by gender
SYLLABLES = {
    "latin": ("Al Be Co Da El Fi Ga Ha Jo Ka Le Mi No Pe Ri So".split(), "bar den fel gor lan mer nis pol ran sel tor ven wik zan dim kor".split(), ("o", "a", "e")),
    "cyrillic": ("Ал Бо Ва Га Да Ев Зо Ка Ле Ми На Ол Па Ро Се То".split(), "бар вен гор дан зел кол лин мар нев пол рин сов тан фил хор чен".split(), ("ов", "ова", "ко")),
    "greek": ("Αλ Βα Γε Δη Ελ Ζω Ηλ Θε Κα Λε Μα Νι Πα Ρο Σο Τι".split(), "βαρ γελ δον ζαν κορ λαν μερ νικ πολ ραν σελ τορ φιλ χαρ μιν δις".split(), ("ος", "α", "ου")),
}


#: every text with a name after a title has this
TITLES = rf"(?=[DFHMPSг])(?:{MALE}|{FEMALE}|{NEUTRAL})\.?[ \u00a0]{{1,2}}\p{{L}}"
#: every text with an entity has one of these: a sign, digits, an account number, a title, a telling name
TRACES = "|".join((
    "@", r"[0-9][0-9 .()/-]{6}", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", TITLES,
    r"[tTsSpPaA](?i:oken|ecret|asswd|assword|pi[_-]?key)[\"']?\s{0,3}[=:]",
))


def _kind(entity: Column) -> Column:
    """Kind of an entity by its form; what has no other form is a name or, if long, a secret."""
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    return (F.when(entity.contains("@"), "email").when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
            .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(entity.rlike(r"^\d[\d -]*$") & (digits >= 13) & (digits <= 19), "card")
            .when(entity.rlike(r"^[+(]\d|^\d{3}[ .-]\d{3}[ .-]\d{4}$|^0\d{1,4}[ /-]\d"), "phone")
            .when(entity.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$"), "iban").otherwise("secret"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def entities(raw: Column, before: Column, names: Column) -> Column:
    """The entities of a text by match, each an array of its parts: lead and tail (kept text around it), raw and kind.

    Kinds of names tell role (given or family), gender and script; initials are a kind of their own.
    raw: all matches; before: the text cut at them; names: (word, kind) known in this text. They have
    to be columns, not expressions, since they are read several times.
    """
    n = F.size(raw)
    found = F.arrays_zip(raw.alias("raw"), F.slice(before, 1, n).alias("before"))
    more = rf"\.?{_GAP}(?:(?:{NEUTRAL})\.?{_GAP})*$"  # Herr Prof. Dr. X

    def part(lead: Column, text: Column, tail: Column, kind: Column) -> Column:
        return F.struct(lead.alias("lead"), text.alias("raw"), tail.alias("tail"), kind.alias("kind"))

    def one(x: Column) -> Column:
        title = x["before"]
        gender = F.when(title.rlike(rf"\b(?:{MALE}){more}"), 0).when(title.rlike(rf"\b(?:{FEMALE}){more}"), 1).otherwise(2)
        words, gaps = F.regexp_extract_all(x["raw"], F.lit(_WORD), F.lit(0)), F.split(x["raw"], _WORD, -1)
        last = F.size(words) - 1

        def named(word: Column, i: Column) -> Column:
            script = _script(word)
            told = F.when((i == last) & (script == "latin"), 2).otherwise(gender)  # Latin family names have no gender
            sort = F.concat_ws("/", F.lit("name"), F.when(i == last, "family").otherwise("given"), told.cast("string"), script)
            return part(F.get(gaps, i), word, F.when(i == last, F.get(gaps, i + 1)).otherwise(""), F.when(F.length(word) == 1, "initial").otherwise(sort))

        known = F.get(F.filter(names, lambda y: y["word"] == F.lower(x["raw"])), F.lit(0))["kind"]
        alone = F.array(part(F.lit(""), x["raw"], F.lit(""), F.coalesce(known, _kind(x["raw"]))))
        after_title = title.rlike(rf"\b{_TITLE}\.?{_GAP}$") & x["raw"].rlike(rf"^{_RUN}$") & ~x["raw"].rlike(r"[\d@]")
        return F.when(after_title, F.transform(words, named)).otherwise(alone)

    return F.transform(found, one)


def known_names(rows: DataFrame) -> DataFrame:
    """k, names (word, kind) and pattern of every text (k, text) that has names after titles; the pattern finds them anywhere in it."""
    cut = rows.where(F.col("text").rlike(TITLES)).select("k", F.regexp_extract_all("text", F.lit(NAMED), F.lit(0)).alias("raw"), F.split("text", NAMED, -1).alias("before"))
    none = F.array().cast("array<struct<word:string,kind:string>>")
    parts = cut.where(F.size("raw") > 0).withColumn("names", none).select("k", F.explode(F.flatten(entities(F.col("raw"), F.col("before"), F.col("names")))).alias("e"))
    parts = parts.where("e.kind like 'name/%'").select("k", F.col("e.raw").alias("raw"), F.lower("e.raw").alias("word"), F.col("e.kind").alias("kind"))
    # one kind for a word; spelled as found, in capitals, or with one
    words = parts.groupBy("k", "word").agg(F.min("kind").alias("kind"), F.collect_set("raw").alias("raw"))
    spelled = F.array_distinct(F.concat("raw", F.array(F.upper("word"), F.concat(F.upper(F.substring("word", 1, 1)), F.substr("word", F.lit(2))))))
    out = words.groupBy("k").agg(F.collect_list(F.struct("word", "kind")).alias("names"), F.flatten(F.collect_list(spelled)).alias("spelled"))
    pattern = F.concat(F.lit(f"{ANY}|(?<!{_BOUND})(?:"), F.array_join("spelled", "|"), F.lit(f")(?!{_BOUND})"))
    return out.select(F.col("k").alias("k_of"), "names", pattern.alias("pattern"))


def canonical(kind: Column, raw: Column) -> Column:
    """The form that all spellings of one entity share."""
    return (F.when(kind == "phone", F.regexp_replace(raw, r"[^+\d]", "")).when(kind.isin("card", "ssn"), F.regexp_replace(raw, r"\D", "")).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
            .when((kind == "email") | kind.startswith("name"), F.lower(raw)).otherwise(raw))


def _stream(key: str, kind: Column, text: Column, attempt: Column, need: Column) -> Column:
    """Hex digits of keyed hashes, two for each of `need` characters and 24 more."""
    blocks = F.sequence(F.lit(0), F.ceil((need + 12) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda i: F.sha2(F.concat_ws("|", F.lit(key), kind, text, attempt.cast("string"), i.cast("string")), 256)), "")


def _byte(stream: Column, j: Column) -> Column:
    """Number below 256 at place j (from 1) of a stream."""
    return F.conv(F.substr(stream, 2 * j - 1, F.lit(2)), 16, 10).cast("int")


LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _cased(c: Column, letters: str, v: Column) -> Column:
    """A letter of an alphabet in the case of c."""
    found = F.substr(F.lit(letters), v % len(letters) + 1, F.lit(1))
    return F.when(c.rlike(r"\p{Lu}"), F.upper(found)).otherwise(found)


def _initial(raw: Column, key: str) -> Column:
    """Another capital of the same script: the alphabet turned by a keyed number of places, so initials stay distinct."""
    v, out = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("initial")), 256), 1, 4), 16, 10).cast("int"), None
    for letters, script in ((CYRILLIC, "cyrillic"), (GREEK, "greek"), (LATIN, "latin")):
        at = F.instr(F.lit(letters), F.lower(raw))
        turned = F.upper(F.substr(F.lit(letters), (at - 1 + 1 + v % (len(letters) - 1)) % len(letters) + 1, F.lit(1)))
        made = F.when(at > 0, turned).otherwise(raw)  # a letter outside the alphabet stands for itself
        out = F.when(_script(raw) == script, made) if out is None else out.when(_script(raw) == script, made)
    return out


def _alike(text: Column, stream: Column, hexed: Column) -> Column:
    """Characters replaced by others of their class; hexadecimal texts stay hexadecimal."""
    def one(j: Column) -> Column:
        c, v = F.substr(text, j, F.lit(1)), _byte(stream, j)
        return (F.when(hexed & c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), v % 16 + 1, F.lit(1)))
                .when(c.rlike("[0-9]"), F.substr(F.lit("0123456789"), v % 10 + 1, F.lit(1)))
                .when(c.rlike("[a-z]"), F.char(v % 26 + 97)).when(c.rlike("[A-Z]"), F.char(v % 26 + 65)).when(c.rlike(r"[\x00-\x7f]"), c)
                .when(c.rlike(r"\p{IsCyrillic}"), _cased(c, CYRILLIC, v)).when(c.rlike(r"\p{IsGreek}"), _cased(c, GREEK, v))
                .when(c.rlike(r"\p{L}"), _cased(c, LATIN, v)).when(c.rlike(r"\p{N}"), (v % 10).cast("string")).otherwise(c))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), "")


def luhn(digits: Column) -> Column:
    """Check sum of a card number, 0 to 9."""
    n = F.length(digits)

    def one(j: Column) -> Column:
        d = F.substr(digits, j, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - j) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x) % 10


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capitals, A as 10 to Z as 35."""
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda j: F.substr(text, j, F.lit(1)))
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step)


def _iban(text: Column, rest: Column) -> Column:
    """An account number of the same country with `rest` behind the check digits, as valid as the original."""
    country = F.substring(text, 1, 2)
    told = mod97(F.concat(F.substr(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)))
    need = F.pmod(told - mod97(F.concat(rest, country, F.lit("00"))), F.lit(97))
    return F.concat(country, F.lpad(F.when(need < 2, need + 97).otherwise(need).cast("string"), 2, "0"), rest)


def _pick(words: list[str], v: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), v % len(words))


def _name(kind: Column, stream: Column, attempt: Column) -> Column:
    """A name of syllables; each further attempt may be one syllable longer, so names never run out."""
    gender, out = F.split(kind, "/")[2].cast("int"), None
    for script, (heads, inner, ends) in SYLLABLES.items():
        parts = F.transform(F.sequence(F.lit(2), F.least(4 + attempt, F.lit(11))), lambda j: _pick(inner, _byte(stream, j)))
        made = F.concat(_pick(heads, _byte(stream, F.lit(1))), F.array_join(parts, ""), F.get(F.array(*map(F.lit, ends)), gender))
        out = F.when(F.endswith(kind, F.lit(script)), made) if out is None else out.when(F.endswith(kind, F.lit(script)), made)
    return out


def _ip(text: Column, stream: Column, attempt: int) -> Column:
    """An address of the same private block; then one of 10.*, then any, then one of the private IPv6 block."""
    octets = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: (1 + _byte(stream, j) % 254).cast("string"))
    if attempt >= 3 * STAY:
        groups = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.substr(stream, 4 * i + 3, F.lit(4)))
        return F.concat(F.lit("fd"), F.substring(stream, 1, 2), F.lit(":"), F.array_join(groups, ":"))
    private = F.regexp_extract(text, r"^(?:10\.|192\.168\.|127\.|172\.(?:1[6-9]|2\d|3[01])\.)", 0)
    if attempt >= STAY:
        private = F.when(private != "", F.lit("10." if attempt < 2 * STAY else "")).otherwise("")
    skip = F.length(F.regexp_replace(private, "[^.]", ""))
    return F.concat(private, F.array_join(F.slice(octets, skip + 1, 4 - skip), "."))


def candidates(forms: DataFrame, key: str, attempt: int) -> DataFrame:
    """Add s, the surrogate of every canonical form (kind, text) at an attempt.

    Built column by column: a later one reads the earlier ones instead of repeating them.
    """
    kind, text, stream, digits = F.col("kind"), F.col("text"), F.col("stream"), F.col("digits")
    mail = kind == "email"
    more = max(0, attempt + 1 - STAY)  # characters that the original doesn't have, so that no pool runs out
    rows = forms.withColumn("stream", _stream(key, kind, text, F.lit(attempt), F.length(text)))
    rows = rows.withColumn("more", F.substr(_stream(key, kind, F.concat(F.lit("more|"), text), F.lit(attempt), F.lit(more)), F.lit(1), F.lit(more)))
    tail = F.when(mail, F.translate("more", "0123456789", "ghijklmnop")).when(kind == "secret", F.col("more")).otherwise(F.translate("more", "abcdef", "012345"))
    rows = rows.withColumn("digits", F.concat(_alike(F.when(mail, F.substring_index(text, "@", 1)).otherwise(text), stream, (kind == "secret") & text.rlike("^[0-9a-f]+$")), tail))
    rows = rows.withColumn("domain", F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(text, "@", -1)), 256))
    rows = rows.withColumn("body", F.when(kind == "card", F.concat(F.substr(digits, F.lit(1), F.length(text) - 1), tail, F.lit("0"))))
    address = F.concat(digits, F.lit("@m"), F.substring("domain", 1, 10), F.lit(".example."), _pick(["com", "net", "org"], F.conv(F.substring("domain", 11, 2), 16, 10).cast("int")))
    card = F.concat(F.substr("body", F.lit(1), F.length("body") - 1), F.pmod(luhn(text) - luhn(F.col("body")), F.lit(10)).cast("string"))
    phone = F.when(text.startswith("+"), F.concat(F.substring(text, 1, 3), F.substr(digits, F.lit(4), F.length(digits)))).otherwise(digits)
    rows = rows.withColumn("rest", F.when(kind == "iban", F.upper(F.substr(digits, F.lit(5), F.length(digits)))))
    iban = _iban(text, F.col("rest"))
    made = (F.when(mail, address).when(kind == "ip", _ip(text, stream, attempt)).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone)
            .when(kind.startswith("name"), _name(kind, stream, F.lit(attempt))).otherwise(digits))
    return rows.select("kind", "text", made.alias("s"))


def assign(forms: DataFrame, key: str) -> DataFrame:
    """kind, text (canonical, distinct) and surrogate: distinct among each other and from all texts of the kind."""
    spark = forms.sparkSession
    open_ = settle(forms.select("kind", "text").where("kind is not null and text is not null").distinct())
    known = open_.select("kind", F.lower("text").alias("s"))
    done = spark.createDataFrame([], "kind string, text string, s string")
    attempt = 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not open_.isEmpty():
        # short rows, long expressions: dealt out by number, so that small partitions are not put together
        made = settle(candidates(open_.repartition(parts, "kind", "text"), key, attempt))
        fold = F.lower("s").alias("s")  # names are compared without case
        first = made.groupBy("kind", fold).agg(F.min("text").alias("text"))
        taken = done.select("kind", fold).unionByName(known)
        won = first.join(taken, ["kind", "s"], "left_anti").select("kind", "text")
        done = settle(done.unionByName(made.join(won, ["kind", "text"], "left_semi")))
        open_ = settle(open_.join(won, ["kind", "text"], "left_anti"))
        attempt += 1
    return done


def _render(kind: Column, raw: Column, s: Column) -> Column:
    """The surrogate in the spelling of the original: its separators and capitals."""
    plain = F.translate(s, "+", "")
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))

    def put(a: Column, c: Column) -> Column:
        taken = F.struct(F.concat(a["t"], F.substr(plain, a["k"], F.lit(1))).alias("t"), (a["k"] + 1).alias("k"))
        return F.when(c.rlike("[0-9A-Za-z]"), taken).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["k"].alias("k")))

    spread = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda j: F.substr(raw, j, F.lit(1))), start, put)
    spread = F.concat(spread["t"], F.substr(plain, spread["k"], F.length(plain)))  # surrogates of late attempts are longer
    name = F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(s)).otherwise(s)
    return F.when(kind.isin("card", "ssn", "iban", "phone"), spread).when(kind.startswith("name"), name).otherwise(s)


def one_kind(forms: DataFrame) -> DataFrame:
    """Adds `sort`, the kind that gets a surrogate. A name has one whatever its role and title: the gender that any of its titles tells, male first."""
    gender = F.split("kind", "/")[2]
    told = forms.where("kind like 'name/%'").groupBy("text").agg(F.min(gender).alias("told"))
    out = forms.join(told, "text", "left")
    script = F.split("kind", "/")[3]
    return out.withColumn("sort", F.when(F.col("kind").startswith("name/"), F.concat_ws("/", F.lit("name"), F.lit("any"), "told", script)).otherwise(F.col("kind"))).drop("told")


def replace(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", count: str | None = None) -> DataFrame:
    """Every row with the entities of its text replaced; `count` names a column for their number."""
    kept = [c for c in docs.columns if c.lower() != (count or "").lower()]
    k, outs, where, found, pattern = fresh(docs, "row_key", "row_out", "row_k", "row_found", "row_pattern")
    mine = F.struct(F.col(id_col).alias("id"), F.md5(text_col).alias("t"))
    has = F.coalesce(F.col(text_col).rlike(TRACES), F.lit(False))
    names = settle(known_names(docs.where(has).select(mine.alias("k"), F.col(text_col).alias("text"))))
    rows = docs.where(has).select(mine.alias("k"), F.col(text_col).alias("text")).join(names, F.col("k").eqNullSafe(F.col("k_of")), "left")
    rows = rows.withColumn("pattern", F.coalesce("pattern", F.lit(ANY)))
    rows = rows.select("k", "names", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("raw"), F.split("text", F.col("pattern"), -1).alias("before"))
    rows = rows.where(F.size("raw") > 0).select("k", F.posexplode(entities(F.col("raw"), F.col("before"), F.col("names"))).alias("i", "parts"))
    rows = rows.select("k", "i", F.posexplode("parts").alias("j", "e"))
    seen = settle(rows.select("k", "i", "j", "e.lead", "e.raw", "e.tail", "e.kind").distinct())
    forms = seen.select("kind", "raw").distinct().withColumn("text", canonical(F.col("kind"), F.col("raw")))
    initials = forms.where("kind = 'initial'").select("kind", "raw", _initial(F.col("raw"), key).alias("new"))
    forms = forms.where("kind <> 'initial'")
    forms = settle(one_kind(forms))
    given = assign(forms.select(F.col("sort").alias("kind"), "text"), key).withColumnRenamed("kind", "sort")
    made = forms.join(given, ["sort", "text"]).select("kind", "raw", _render(F.col("kind"), F.col("raw"), F.col("s")).alias("new")).unionByName(initials)
    put = seen.join(made, ["kind", "raw"]).groupBy("k", "i").agg(F.array_sort(F.collect_list(F.struct("j", F.concat("lead", "new", "tail").alias("new")))).alias("new"))
    put = put.select("k", "i", F.array_join("new.new", "").alias("new"), F.size("new").alias("n"))
    put = put.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "new"))).alias(outs), F.sum("n").alias(found)).withColumnRenamed("k", where)
    put = put.join(names.select("k_of", F.col("pattern").alias(pattern)), F.col(where).eqNullSafe(F.col("k_of")), "left").drop("k_of")

    (pieces,) = fresh(docs, "row_pieces")
    cut = F.col(pieces)
    joined = F.concat(F.array_join(F.zip_with(F.slice(cut, 1, F.size(outs)), outs, lambda a, b: F.concat(a, b["new"])), ""), F.element_at(cut, -1))
    text = F.when(F.col(outs).isNull(), F.col(text_col)).otherwise(joined)
    columns = [F.col(f"`{c}`") for c in kept]
    touched = docs.where(has).withColumn(k, mine).join(put, F.col(k).eqNullSafe(F.col(where)), "left")
    touched = touched.withColumn(pieces, F.when(F.col(outs).isNotNull(), F.split(text_col, F.coalesce(pattern, F.lit(ANY)), -1)))
    touched = touched.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], F.coalesce(found, F.lit(0)).alias(found))
    out = docs.where(~has).select(*columns, F.lit(0).alias(found)).unionByName(touched)
    return out.select(*columns, *([F.col(found).cast("long").alias(count)] if count else []))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


QUERIES = {"op4_surrogates": op4_surrogates}
