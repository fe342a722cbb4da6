"""Personal data: detected entities are replaced by keyed surrogates of the same type, gender, script and format.

An entity is known by its canonical form: digits alone for numbers, lower case for addresses, tokens and names. Its surrogate is a
function of a key, its kind, its canonical form and an attempt, so that every mention anywhere gets the same one, written
in the mention's own format: separators, upper case, lengths and valid check digits stay. The key is the session's (KEY_CONF); where that is unset
a session draws its own, so surrogates of different sessions cannot be matched. Names are found after a title and replaced word by word; after
a title that tells no gender, a given name's ending does; in a text with such a name its words are replaced wherever they stand alone with a capital, with or without a title. Attempts are raised, in rounds over the distinct entities, until no two entities of
a kind share a surrogate and no surrogate is an entity of the corpus. Only entities with a raised attempt have to be looked up.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.llm.common import materialize, read, text_of

#: The setting that holds the key of surrogates.
KEY_CONF = "spark.chronoframe.surrogateKey"
#: Rounds of collision checks before giving up; each round's surrogates are drawn from a larger space.
ROUNDS = 40

#: Repeated groups are bounded in all patterns, as each turn of one takes stack, and runs that a pattern tries from many places are bounded too.
EMAIL = r"(?<![A-Za-z])[A-Za-z0-9][A-Za-z0-9._%+-]{0,254}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,60}\.[A-Za-z]{2,}"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
TOKEN = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
IP6 = r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[Ff][Ee]80:(?::[0-9A-Fa-f]{1,4}){1,4})(?![\w:])"
SECRET = r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,255}|sk-[0-9A-Za-z_-]{20,200}|xox[abprs]-[0-9A-Za-z-]{10,200})(?![0-9A-Za-z])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "κυρία", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")
#: Titles in capitals, before a name in capitals.
CAPITALS = ("MR", "SIR", "MRS", "MISS", "DR", "PROF")
#: Small words within family names, which stay.
PARTICLES = ("al", "bin", "da", "de", "del", "den", "der", "di", "do", "dos", "du", "el", "ibn", "la", "las", "le", "los", "ter", "van", "von", "zu")
#: An initial, or a word with a capital that an apostrophe may precede and hyphens and apostrophes may go on.
_PART = r"(?:\p{Lu}\.(?=[ \u00A0])|(?:\p{Lu}['’])?\p{Lu}\p{L}++(?:['’-]\p{L}++){0,3}+)"
_LOUD = r"\p{Lu}{2,}+(?:['’-]\p{Lu}{2,}+){0,3}+"
_TITLED = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.?[\s\u00A0]{{1,3}}{_PART}(?:[ \u00A0]{{1,2}}(?:(?:{'|'.join(PARTICLES)})[ \u00A0]){{0,3}}{_PART}){{0,2}}"
_PARTICLED = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.?[\s\u00A0]{{1,3}}(?:(?:{'|'.join(PARTICLES)})[ \u00A0]){{1,3}}{_PART}"
NAME = rf"(?<!\p{{L}})(?:{_TITLED}|{_PARTICLED}|(?:{'|'.join(CAPITALS)})\.?[\s\u00A0]{{1,3}}{_LOUD}(?:[ \u00A0]{{1,2}}{_LOUD}){{0,2}}(?!\p{{L}}))"
#: What each pattern's first character may be, looked at first: most places in a text are ruled out by it.
_STARTS = (("[A-Za-z0-9]", EMAIL), (r"\d", IP), ("[A-Z]", IBAN), ("[0-9A-Fa-f]", TOKEN), ("[0-9A-Fa-f]", IP6), ("[Agsx]", SECRET), (r"[\d+(]", PHONE), (r"\d", SSN), (r"\d", CARD), ("[DFHMPSГгΚκ]", NAME))
_either = lambda patterns: "|".join(f"(?={start})(?:{pattern})" for start, pattern in _STARTS if pattern in patterns)
#: Numbers may follow a letter; all others may not, so that most places in a text are ruled out at once.
_NUMBERS = (PHONE, SSN, CARD)
ANY = rf"(?<![A-Za-z])(?:{_either([pattern for _, pattern in _STARTS if pattern not in _NUMBERS])})|(?=[\d+(])(?:{_either(_NUMBERS)})"

#: Words and what is between them; together all of a text.
_TOKENS = r"\p{L}+|\P{L}+"

#: Syllables of made-up names; the endings tell the gender of given names.
SYLLABLES = {"latin": "ka ri mo le sa ni to ve da lu be no ra mi so te la ju ne vi".split(), "cyrillic": "ка ри мо ле са ни то ве да лу бе но ра ми со те ла зу не ви".split(), "greek": "κα ρι μο λε σα νι το βε δα λυ πε νο ρα μι σο τε λα ζυ νε βι".split()}
ENDINGS = {"latin": ("n", "a", "r"), "cyrillic": ("н", "я", "р"), "greek": ("ς", "α", "ρ")}


def kind_of(match: Column) -> Column:
    """Of a whole match of ANY; the first pattern that matches all of it."""
    kinds = (("email", EMAIL), ("ip", IP), ("iban", IBAN), ("token", TOKEN), ("ip6", IP6), ("secret", SECRET), ("phone", PHONE), ("ssn", SSN), ("card", CARD))
    out = F.lit("name")
    for kind, pattern in reversed(kinds):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def parts_of(match: Column) -> Column:
    """Array of (kind, word) that joined give the match: of a name, the title, particles, an s after an apostrophe and what is between words are kept ("title"); its last word of two letters or more is a family name, the words before and initials are given names."""
    tokens = F.regexp_extract_all(match, F.lit(_TOKENS), F.lit(0))
    title = F.get(tokens, 0)
    capitals = F.upper(title)
    told = F.when(title.isin(*FEMALE) | capitals.isin("MRS", "MISS"), F.lit("given_f")).when(~capitals.isin("DR", "PROF", "PROFESSOR"), F.lit("given_m"))
    part = lambda kind, word: F.struct(kind.alias("kind"), word.alias("word"))
    counts = lambda t, i: (i > 0) & t.rlike(r"^\p{L}") & ~t.isin(*PARTICLES) & ((F.length(t) > 1) | (F.lower(t) != t))
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(counts(t, i) & (F.length(t) > 1), i)))
    given = lambda t: F.coalesce(told, F.when(t.rlike("(?iu)[aeаяαη]$"), F.lit("given_f")).otherwise(F.lit("given_m")))
    name = F.transform(tokens, lambda t, i: part(F.when(~counts(t, i), F.lit("title")).when(i == last, F.lit("family")).otherwise(given(t)), t))
    return F.when(kind_of(match) == "name", name).otherwise(F.array(part(kind_of(match), match)))


def canonical(kind: Column, word: Column) -> Column:
    return F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(word, r"\D", "")).when(kind == "iban", F.replace(word, F.lit(" "), F.lit(""))).when(kind == "secret", word).otherwise(F.lower(word))


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i if isinstance(i, Column) else F.lit(i)), F.lit(n)).cast("int")


def _shaped(text: Column, seed: Column, keep: Column) -> Column:
    """text with other letters for a-z and A-Z and other digits for 0-9; the first `keep` characters and all others stay."""

    def char(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        letter = lambda letters: F.substring(F.lit(letters), _draw(seed, i, 26) + 1, F.lit(1))
        digit = F.when((i == 1) & (c != "0"), _draw(seed, i, 9) + 1).otherwise(_draw(seed, i, 10)).cast("string")
        return F.when(i <= keep, c).when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[0-9]"), digit).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), char), "")


def _luhn(digits: Column) -> Column:
    """The check digit after these digits."""
    n = F.length(digits)

    def weigh(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(-F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), weigh), F.lit(10)).cast("string")


def _mod97(iban: Column) -> Column:
    """The remainder by 97 of the number that an IBAN without spaces stands for, letters as 10 to 35; 1 for a valid one."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.rlike("[A-Z]"), (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)


def _name(kind: Column, word: Column, seed: Column, attempt: Column) -> Column:
    """Two syllables or more, the more the later the attempt, and an ending that fits the gender."""

    def of(script: str) -> Column:
        pool, (m, f, family) = F.array(*[F.lit(s) for s in SYLLABLES[script]]), ENDINGS[script]
        body = F.array_join(F.transform(F.sequence(F.lit(1), 3 + F.floor(attempt / 2).cast("int")), lambda i: F.get(pool, _draw(seed, i, len(SYLLABLES[script])))), "")
        return F.concat(body, F.when(kind == "given_f", f).when(kind == "given_m", m).otherwise(family))

    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def with_surrogate(df: DataFrame, kind: str, word: str, attempt: Column, key: str) -> DataFrame:
    """df with `new`, the canonical form of the replacement of the entity whose kind and canonical form are in the columns so named.

    The seed is a column of its own: inside the functions over characters it would be drawn anew for each of them.
    """
    k, w, seed, card = F.col(kind), F.col(word), F.col("_seed"), F.col("_card")
    seeded = df.withColumn("_seed", F.sha2(F.concat_ws("\x1f", F.lit(key), k, w, attempt.cast("string")), 256)).withColumn("_attempt", attempt)
    front = F.substring(w, F.lit(1), F.length(w) - 1)
    seeded = seeded.withColumn("_front", F.when(k == "card", front)).withColumn("_card", F.when(k == "card", _shaped(F.col("_front"), seed, F.lit(1))))
    # an IBAN's two check digits follow from its country and the rest
    bank = F.when(k == "iban", F.concat(F.substring(w, 1, 2), F.lit("00"), F.substring(_shaped(w, seed, F.lit(2)), F.lit(5), F.length(w))))
    seeded = seeded.withColumn("_bank", bank)
    with_check = F.concat(F.substring("_bank", 1, 2), F.format_string("%02d", F.lit(98) - _mod97(F.col("_bank"))), F.substring(F.col("_bank"), F.lit(5), F.length(w)))
    loose = F.concat(F.substring(w, 1, 2), F.format_string("%02d", _draw(seed, 98, 100)), F.substring(F.col("_bank"), F.lit(5), F.length(w)))
    prefix = F.length(F.regexp_extract(w, r"^(?:AKIA|gh[opsur]_|sk-|xox[abprs]-)", 0))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    tld = F.regexp_extract(w, r"\.[a-z]+$", 0)
    body = F.substring(w, F.lit(1), F.length(w) - F.length(tld))
    checked = _luhn(F.col("_front")) == F.substring(w, -1, 1)
    digits = F.concat(card, F.when(checked, _luhn(card)).otherwise(_draw(seed, 99, 10).cast("string")))
    hex_token = F.array_join(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.lit("0123456789abcdef"), _draw(seed, i, 16) + 1, F.lit(1))), "")
    new = (
        F.when(k == "email", F.concat(_shaped(body, seed, F.lit(0)), tld))
        .when(k == "ip", octets)
        .when(k == "token", hex_token)
        .when(k == "card", digits)
        .when(k == "phone", _shaped(w, seed, F.lit(1)))
        .when(k == "ssn", _shaped(w, seed, F.lit(0)))
        .when(k == "iban", F.when(_mod97(w) == 1, with_check).otherwise(loose))
        .when(k == "secret", _shaped(w, seed, prefix))
        .when(k == "ip6", F.array_join(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.when(F.substring(w, i, F.lit(1)) == ":", F.lit(":")).otherwise(F.substring(F.lit("0123456789abcdef"), _draw(seed, i, 16) + 1, F.lit(1)))), ""))
        .otherwise(_name(k, w, seed, F.col("_attempt")))
    )
    return seeded.withColumn("new", new).drop("_seed", "_attempt", "_front", "_card", "_bank")


def in_format(kind: Column, word: Column, new: Column) -> Column:
    """The canonical replacement written as the mention is: its separators, its upper case, its capital."""
    places = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.when(F.substring(word, i, F.lit(1)).rlike(r"\d"), F.substring(new, F.length(F.regexp_replace(F.substring(word, F.lit(1), i), r"\D", "")), F.lit(1))).otherwise(F.substring(word, i, F.lit(1))))
    spaced = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.when(F.substring(word, i, F.lit(1)) != " ", F.substring(new, F.length(F.replace(F.substring(word, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1))).otherwise(F.lit(" ")))
    cased = F.when(kind.isin("given_m", "given_f") & (F.length(word) == 1), F.upper(F.substring(new, 1, 1))).when((F.upper(word) == word) & (F.lower(word) != word), F.upper(new)).when(kind.isin("given_m", "given_f", "family"), F.initcap(new)).otherwise(new)
    return F.when(kind.isin("phone", "ssn", "card"), F.array_join(places, "")).when(kind == "iban", F.array_join(spaced, "")).otherwise(cased)


def raised_attempts(entities: DataFrame, key: str) -> DataFrame:
    """entities: kind, word, distinct. Returns kind, word, attempt of those whose first surrogate collides."""
    known = entities.select("kind", F.col("word").alias("new"))
    pending = entities.withColumn("attempt", F.lit(0))
    settled = raised = None
    for _ in range(ROUNDS):
        drawn = with_surrogate(pending, "kind", "word", F.col("attempt"), key)
        free = drawn.join(known, ["kind", "new"], "left_anti")
        free = free if settled is None else free.join(settled, ["kind", "new"], "left_anti")
        # of several that draw the same, the least keeps it
        won = free.groupBy("kind", "new").agg(F.min(F.struct("word", "attempt")).alias("w")).select("kind", "new", "w.word", "w.attempt")
        won = materialize(won, "pii-settled")
        lost = materialize(pending.join(won.select("kind", "word"), ["kind", "word"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "pii-pending")
        settled = won.select("kind", "new") if settled is None else settled.unionByName(won.select("kind", "new"))
        more = won.where(F.col("attempt") > 0).select("kind", "word", "attempt")
        raised = more if raised is None else raised.unionByName(more)
        pending = lost
        if lost.isEmpty():
            return materialize(raised, "pii-raised")
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def bare(token: Column, names: Column) -> Column:
    """The surrogate of a capitalised word that is part of a name of its text, written as it is; null for other tokens."""
    new = F.when(token.rlike(r"^\p{Lu}\p{L}"), F.try_element_at(names, F.lower(token)))
    return F.when(F.upper(token) == token, F.upper(new)).otherwise(F.initcap(new))


def mentions(found: DataFrame) -> DataFrame:
    """found: hash, found. Returns hash, place, part, kind, word (as written), canonical: one row per part of a mention in every distinct text."""
    d = found.where(F.size("found") > 0).dropDuplicates(["hash"])
    d = d.select("hash", F.posexplode("found").alias("place", "match")).select("hash", "place", F.posexplode(parts_of(F.col("match"))).alias("part", "p")).select("hash", "place", "part", "p.kind", "p.word")
    return d.withColumn("canonical", canonical(F.col("kind"), F.col("word")))


def session_key(spark: SparkSession) -> str:
    """The key that the session names; a fresh one, kept for the session, where it names none."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
    return key


def replaced(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with surrogates in the text, and n_entities, the number of mentions that were replaced; a bare word of a name is one.

    Texts are searched once; what was found is written beside the rows. Rows without a mention are passed through untouched and
    unshuffled; null texts stay null. A column named n_entities is replaced.
    """
    kept, key = docs.drop("n_entities"), key or session_key(docs.sparkSession)
    found = F.regexp_extract_all(text_of(text_col), F.lit(ANY), F.lit(0))
    searched = materialize(kept.select(F.struct(*kept.columns).alias("row"), F.sha2(text_of(text_col), 256).alias("hash"), found.alias("found")), "pii-searched")
    said = materialize(mentions(searched.select("hash", "found")), "pii-mentions")
    entities = said.where(F.col("kind") != "title").select("kind", F.col("canonical").alias("word")).distinct()
    raised = raised_attempts(entities, key).withColumnRenamed("word", "canonical")
    drawn = with_surrogate(said.join(raised, ["kind", "canonical"], "left"), "kind", "canonical", F.coalesce("attempt", F.lit(0)), key)
    drawn = materialize(drawn.select("hash", "place", "part", "kind", "word", "canonical", "new"), "pii-drawn")
    # of a word that is a family name and a given name in one text, the family name's
    alone = drawn.where(F.col("kind").isin("given_m", "given_f", "family")).groupBy("hash", "canonical").agg(F.min(F.struct("kind", "new")).alias("w"))
    names = alone.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "w.new"))).alias("_names"))
    written = drawn.withColumn("new", F.when(F.col("kind") == "title", F.col("word")).otherwise(in_format(F.col("kind"), F.col("word"), F.col("new"))))
    # the parts of one mention, then the mentions of one text
    by_place = written.groupBy("hash", "place").agg(F.sort_array(F.collect_list(F.struct("part", "new"))).alias("parts"))
    by_place = by_place.select("hash", F.struct("place", F.array_join(F.col("parts.new"), "").alias("new")).alias("at"))
    by_text = by_place.groupBy("hash").agg(F.sort_array(F.collect_list("at")).alias("news"))
    between = F.split(F.col("row")[text_col], ANY, -1)
    with_mentions = searched.where(F.size("found") > 0).select("row", "hash", F.size("found").alias("_n"), between.alias("_between"))
    joined = with_mentions.join(by_text.join(names, "hash", "left"), "hash")
    tokens = F.transform("_between", lambda text: F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)))
    joined = joined.withColumn("_tokens", F.when(F.col("_names").isNotNull(), tokens))
    news = F.transform("_tokens", lambda ts: F.transform(ts, lambda t: bare(t, F.col("_names"))))
    joined = joined.withColumn("_bare", news)
    joined = joined.withColumn("_n", F.col("_n") + F.coalesce(F.aggregate("_bare", F.lit(0), lambda n, ts: n + F.size(F.filter(ts, lambda t: t.isNotNull()))), F.lit(0)))
    named = F.zip_with("_tokens", "_bare", lambda ts, ns: F.array_join(F.zip_with(ts, ns, lambda t, new: F.coalesce(new, t)), ""))
    joined = joined.withColumn("_between", F.coalesce(named, F.col("_between")))
    rebuilt = F.array_join(F.zip_with("_between", "news", lambda text, at: F.concat(text, F.coalesce(at["new"], F.lit("")))), "")
    changed = joined.select(*[(rebuilt if c == text_col else F.col("row")[c]).alias(c) for c in kept.columns], F.col("_n").cast("long").alias("n_entities"))
    same = searched.where(F.size("found") == 0).select(*[F.col("row")[c].alias(c) for c in kept.columns], F.lit(0).cast("long").alias("n_entities"))
    return changed.unionByName(same)


def op8_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


QUERIES = {"op8_personal": op8_personal}
