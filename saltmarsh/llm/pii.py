"""Surrogates for personal data, by DataFrame functions alone.

Entities are found by pattern in one pass over the texts; each distinct one gets a keyed surrogate of
its own type and form, collisions (with another surrogate or with any entity of the corpus) are
settled by further attempts, and the texts are put together again. What counts as one entity is its
plain form: numbers without their spacing, addresses without case, and every part of a person's
name by itself, so that "Dr Anna Schmidt", "Frau Schmidt" and "Anna Schmidt" keep their likeness.
Names without a title are replaced where the same text has them with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import staged, table

#: Titles by gender.
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
TITLED = "|".join(MALE + FEMALE + NEUTRAL)
LOUD = "|".join(t.upper() for t in MALE + FEMALE + NEUTRAL)
#: Words with a capital that end a name, and that alone are no name of somebody met before.
COMMON = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag", "Januar", "Februar", "März", "Mai", "Juni", "Juli", "Oktober", "Dezember",
    "Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche", "Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo",
    "The", "This", "That", "These", "There", "Then", "When", "Where", "What", "Who", "Why", "How", "And", "But", "For", "From", "With", "About", "After", "Before", "On", "In", "At", "As", "If", "It", "Its", "He", "She", "We", "They", "You", "Your", "Our", "His", "Her", "My",
    "Is", "Was", "Are", "Were", "Will", "Would", "Can", "Could", "Should", "Has", "Have", "Had", "Did", "Does", "Please", "Dear", "Yes", "No", "Not",
    "Der", "Die", "Das", "Und", "Ich", "Wir", "Sie", "Er", "Es", "Am", "Im", "Le", "La", "Les", "Un", "Une", "Il", "Elle", "Nous", "Vous", "Je", "El", "Los", "Las", "Una", "Ella", "Ellos", "Nosotros",
)
_PART, _LOUD_PART = r"\p{Lu}[\p{L}'’-]+", r"\p{Lu}[\p{Lu}'’-]+"


def _more(part: str, words: tuple[str, ...], most: int) -> str:
    """Further parts of a name."""
    return r"(?: (?!(?:" + "|".join(words) + r")(?![\p{L}'’-]))" + part + r"){0," + str(most) + "}"


#: In loud texts, where every word has capitals, a name has two parts at most.
_PERSON = r"(?:(?:" + TITLED + r")\.? )+" + _PART + _more(_PART, COMMON, 2) + r"|(?:(?:" + LOUD + r")\.? )+" + _LOUD_PART + _more(_LOUD_PART, tuple(w.upper() for w in COMMON), 1) + r"(?!\p{L})"

#: What letters and digits mixed follow if they are a secret.
_AFTER = r"(?<=(?:[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET)[\"']?(?:\s{0,2}(?:[:=]|is)\s{0,2}|\s)[\"']?)"

#: In order: the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,128}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9_]{16,64}|(?=[A-Za-z0-9]{20})(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])" + _AFTER + r"[A-Za-z0-9]{20,128})(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    # Not of a beauty contest.
    "person": r"(?<!\p{L})(?!(?<=[Tt]he )Miss )(?:" + _PERSON + ")",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
TITLES = r"^(?:(?:" + TITLED + "|" + LOUD + r")\.? )+"
PREFIX = "^(?:sk|pk|ghp|AKIA)[-_]?"
#: Attempts at a surrogate after which it becomes longer by a character (a name: by a syllable; an address,
#: of which there are four thousand million, stays one).
LENGTHEN = 4


def entity_kind(entity: Column) -> Column:
    """The type of a found entity."""
    # A secret known by the word before it has no such word here; a person has a title and a space.
    kind = F.when(entity.rlike("^[A-Za-z0-9]+$"), F.lit("secret")).otherwise(F.lit("person"))
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _nibbles(digest: Column, i: Column, n: int = 4) -> Column:
    """A number from n hex digits of the digest (128 digits, used cyclically)."""
    return F.conv(F.substring(digest, F.pmod(i * n, F.lit(128 - n)) + 1, F.lit(n)), 16, 10).cast("int")


def _letters(r: Column, c: Column) -> Column:
    """A letter of c's case and script; other characters stay."""
    def pick(alphabet: str) -> Column:
        return F.substring(F.lit(alphabet), F.pmod(r, F.lit(len(alphabet))) + 1, F.lit(1))

    def span(first: str, last: str, skip: str = "") -> str:
        return "".join(ch for ch in map(chr, range(ord(first), ord(last) + 1)) if ch not in skip)

    out = c
    for pattern, alphabet in (
        (r"\p{IsGreek}&&\p{Lu}", span("Α", "Ω", "΢")), (r"\p{IsGreek}&&\p{Ll}", span("α", "ω", "ς")),
        (r"\p{IsCyrillic}&&\p{Lu}", span("А", "Я", "ЪЫЬ")), (r"\p{IsCyrillic}&&\p{Ll}", span("а", "я", "ъыь")),
        (r"\p{IsLatin}&&\p{Lu}", span("A", "Z")), (r"\p{IsLatin}&&\p{Ll}", span("a", "z")),
    ):
        script, case = pattern.split("&&")
        out = F.when(c.rlike(f"^[{script}&&{case}]$"), pick(alphabet)).otherwise(out)
    return F.when(c.rlike("^[0-9]$"), F.pmod(r, F.lit(10)).cast("string")).otherwise(out)


def _scrambled(entity: Column, digest: Column) -> Column:
    """Digits for digits, letters for letters of the case and script, the rest as it is."""
    chars = F.split(entity, "")
    return F.concat_ws("", F.transform(chars, lambda c, i: _letters(_nibbles(digest, i), c)))


def _hexed(entity: Column, digest: Column) -> Column:
    """Hex digits for hex digits, letters of each one's case; all of one case stay so."""
    digit = lambda i: F.substring(digest, F.pmod(i * 5, F.lit(127)) + 1, F.lit(1))
    made = F.concat_ws("", F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), digit(i)).when(c.rlike("^[A-F]$"), F.upper(digit(i))).otherwise(c)))
    return F.when(entity.rlike("[A-F]") & ~entity.rlike("[a-f]"), F.upper(made)).otherwise(made)


def _address(entity: Column, digest: Column) -> Column:
    """Octets from 1 to 254."""
    return F.concat_ws(".", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_nibbles(digest, i, 6), F.lit(254)) + 1).cast("string")))


def _luhn(digits: Column) -> Column:
    """The check sum of a string of 16 digits."""
    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise((2 * F.substring(digits, i, F.lit(1)).cast("int")).cast("int") - F.when(F.substring(digits, i, F.lit(1)) >= "5", 9).otherwise(0))), F.lit(10))


def _card(entity: Column, digest: Column) -> Column:
    """16 digits in the same grouping; a valid check digit stays valid, an invalid one invalid."""
    new = _scrambled(entity, digest)
    plain = lambda c: F.regexp_replace(c, "[^0-9]", "")
    bare = F.concat(F.substring(plain(new), F.lit(1), F.lit(15)), F.lit("0"))
    right = F.pmod(10 - _luhn(bare), F.lit(10))
    last = F.when(_luhn(plain(entity)) == 0, right).otherwise(F.pmod(right + 1 + F.pmod(_nibbles(digest, F.lit(30)), F.lit(9)), F.lit(10)))
    return F.concat(F.substring(new, F.lit(1), F.length(new) - 1), last.cast("string"))


def _email(entity: Column, digest: Column) -> Column:
    """Local part and host by form; the last two labels go to the reserved example domain's own."""
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    sub = F.substring_index(host, ".", 1)
    new_host = F.when(host.rlike(r"example\.(com|org|net)$"), F.concat(_scrambled(sub, F.reverse(digest)), F.substring(host, F.length(sub) + 1, F.length(host)))).otherwise(F.concat(_scrambled(sub, F.reverse(digest)), F.lit(".example."), F.when(F.substring_index(host, ".", -1).isin("com", "org", "net"), F.substring_index(host, ".", -1)).otherwise("com")))
    return F.concat(_scrambled(local, digest), F.lit("@"), new_host)


def _secret(entity: Column, digest: Column) -> Column:
    """The prefix that tells the kind of secret stays."""
    prefix = F.regexp_extract(entity, PREFIX, 0)
    rest = F.substring(entity, F.length(prefix) + 1, F.length(entity))
    return F.when(entity.rlike("^[0-9A-Fa-f]{32,128}$"), _hexed(entity, digest)).otherwise(F.concat(prefix, _scrambled(rest, digest)))


def _iban_rest(plain: Column) -> Column:
    """The account number with the check digits, modulo 97; 1 if they are right."""
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4))), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c), F.lit(97)))


def _iban(plain: Column, digest: Column) -> Column:
    """The country stays; check digits that are right stay right, wrong ones wrong."""
    country = F.substring(plain, F.lit(1), F.lit(2))
    account = _scrambled(F.substring(plain, F.lit(5), F.length(plain)), digest)
    right = 98 - _iban_rest(F.concat(country, F.lit("00"), account))
    check = F.when(_iban_rest(plain) == 1, right).otherwise(F.pmod(right + 1 + _nibbles(digest, F.lit(31)) % 90, F.lit(97)))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)


def _phone(plain: Column, digest: Column) -> Column:
    """The calling code stays."""
    code = F.when(plain.startswith("+"), F.regexp_extract(plain, CALLING, 0)).otherwise(F.lit(""))
    return F.concat(code, _scrambled(F.substring(plain, F.length(code) + 1, F.length(plain)), digest))


#: Calling codes of one and two digits (a fixed value); all others have three.
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _name(part: Column, digest: Column, gender: Column, syllables: int) -> Column:
    """Syllables of the part's script with an ending of the gender, if that is known; a letter with an
    apostrophe before the name and a hyphen in it stay."""

    def made(consonants: str, vowels: str, woman: str, man: str) -> Column:
        def stem(digest: Column) -> Column:
            letter = lambda s, k: F.substring(F.lit(s), F.pmod(_nibbles(digest, F.lit(k)), F.lit(len(s))) + 1, F.lit(1))
            return F.concat(*[letter((consonants, vowels)[k % 2], k) for k in range(2 * syllables + 1)])

        ending = F.when(gender == "f", woman).when(gender == "m", man).otherwise("")
        lead = F.regexp_extract(part, r"^\p{L}{1,2}['’](?=\p{L}{2})", 0)
        second = F.when(part.rlike(r"\p{L}-\p{L}"), F.concat(F.lit("-"), F.initcap(stem(F.reverse(digest))))).otherwise("")
        return F.concat(F.initcap(lead), F.initcap(stem(digest)), second, ending)

    return F.when(part.rlike(r"^\p{IsCyrillic}"), made("бвдзклмнрст", "аеио", "а", "ор")).when(part.rlike(r"^\p{IsGreek}"), made("βγδκλμνπρστ", "αειο", "α", "ος")).otherwise(made("bdfgklmnprstv", "aeiou", "a", "on"))


def plain_form(entity: Column, kind: Column) -> Column:
    """What makes two spellings one entity."""
    return F.when(kind.isin("phone", "card", "iban", "ssn"), F.regexp_replace(entity, "[^0-9A-Z+]", "")).when(kind.isin("email", "person"), F.lower(entity)).otherwise(entity)


def surrogate(plain: Column, kind: Column, gender: Column, attempt: int, key: str) -> Column:
    """The attempt-th surrogate of a plain form under the key; later ones are longer."""
    digest = F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(half), F.lit(str(attempt)), kind, plain), 256) for half in ("a", "b")])
    out = _scrambled(plain, digest)
    for name, make in (("email", _email), ("secret", _secret), ("ip", _address), ("card", _card), ("iban", _iban), ("phone", _phone)):
        out = F.when(kind == name, make(plain, digest)).otherwise(out)
    more = attempt // LENGTHEN
    if more:
        tail = F.concat(*[F.pmod(_nibbles(digest, F.lit(20 + k)), F.lit(10)).cast("string") for k in range(more)])
        out = F.when(kind == "email", F.concat(F.substring_index(out, "@", 1), tail, F.lit("@"), F.substring_index(out, "@", -1))).when(kind == "ip", out).otherwise(F.concat(out, tail))
    return F.when(kind == "person", _name(plain, digest, gender, 2 + more)).otherwise(out)


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct `plain`, `kind`, with `gender` (m, f or null) -> plain, kind, surrogate: distinct
    within a kind without regard to case, and none an entity of it itself.

    All entities make their first attempt; of those that claim one surrogate the first by order
    keeps it, the others and those that hit a real entity try again, with longer ones after every
    LENGTHEN attempts, until none is left: there are always free ones.
    """
    todo = staged(entities.select("plain", "kind", "gender"), "entities")
    taken = todo.select("kind", F.lower("plain").alias("claim"))
    done: DataFrame | None = None
    attempt = 0
    while True:
        made = todo.withColumn("surrogate", surrogate(F.col("plain"), F.col("kind"), F.col("gender"), attempt, key)).withColumn("claim", F.lower("surrogate"))
        made = staged(made, "attempts")
        free = made.join(taken, ["kind", "claim"], "left_anti")
        won = free.groupBy("kind", "claim").agg(F.min(F.struct("plain", "surrogate")).alias("_w")).select(F.col("_w.plain").alias("plain"), "kind", F.col("_w.surrogate").alias("surrogate"), "claim")
        won = staged(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        left = staged(made.join(won.select("plain", "kind"), ["plain", "kind"], "left_anti").select("plain", "kind", "gender"), "entities")
        if left.isEmpty():
            return done.select("plain", "kind", "surrogate")
        taken, todo, attempt = taken.unionByName(won.select("kind", "claim")), left, attempt + 1


def _laid_out(entity: Column, plain_new: Column) -> Column:
    """The characters of a new plain form in the spacing of the entity; what is left over follows."""
    signs = r"[0-9A-Z+]"
    chars = F.split(entity, "")
    step = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda a, c: F.when(c.rlike(signs), F.struct(F.concat(a["out"], F.substring(plain_new, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))))
    return F.concat(step["out"], F.substring(plain_new, step["at"], F.length(plain_new)))


def _rendered(part: Column, kind: Column, new: Column) -> Column:
    loud = (part == F.upper(part)) & (part != F.lower(part)) & (F.length(part) > 1)
    return F.when(kind.isin("phone", "card", "iban", "ssn"), _laid_out(part, new)).when(kind.isin("email", "person") & loud, F.upper(new)).otherwise(new)


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, + n_entities and kinds (sorted type names).

    A text without entities (null and empty ones too) comes back as it is, with n_entities 0; texts
    may be of any length. Repeated rows are rewritten alike. All columns are carried; columns of docs
    named n_entities or kinds are replaced. An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    found = F.coalesce(F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    rows = docs.select(F.struct(*names).alias("_doc"), F.monotonically_increasing_id().alias("_row"), found.alias("_found"))
    rows = staged(rows, "with_entities")  # the one pass over all texts
    clean = rows.filter(F.size("_found") == 0).select("_doc.*", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))

    # Names that the text has with a title, whole and the last part, are found without one, too.
    text = F.col("_doc")[text_col]
    bare = lambda e: F.regexp_replace(e, TITLES, "")
    uncommon = lambda e: ~F.lower(e).isin(*[w.lower() for w in COMMON])
    titled = F.filter("_found", lambda e: e.rlike(TITLES))
    whole = F.filter(F.transform(titled, bare), uncommon)
    # In a loud text the second word may be any word: only whole names are known by it.
    quiet = F.filter(titled, lambda e: ~e.rlike(r"^(?:" + LOUD + r")\.? "))
    last = F.filter(F.transform(quiet, lambda e: F.substring_index(bare(e), " ", -1)), lambda e: (F.length(e) > 2) & uncommon(e))
    known = F.array_sort(F.array_distinct(F.concat(whole, last)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).otherwise(1))
    hit = rows.filter(F.size("_found") > 0).withColumn("_known", known)
    pattern = F.when(F.size("_known") > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join("_known", "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(ANY))
    hit = staged(hit.select("_doc", "_row", F.regexp_extract_all(text, pattern, F.lit(0)).alias("_found"), F.split(text, pattern, -1).alias("_gaps"), "_known"), "entities_in_place")

    places = hit.select("_row", "_known", F.posexplode("_found").alias("_at", "entity"))
    kind = F.when(F.array_contains("_known", F.col("entity")), F.lit("person")).otherwise(entity_kind(F.col("entity")))
    title = F.when(F.col("kind") == "person", F.regexp_extract("entity", TITLES, 0)).otherwise(F.lit(""))
    places = places.withColumn("kind", kind).withColumn("title", title)
    rest = F.substring(F.col("entity"), F.length("title") + 1, F.length("entity"))
    parts = F.when(F.col("kind") == "person", F.split(rest, " ")).otherwise(F.array(F.col("entity")))
    places = places.withColumn("_parts", parts).select("_row", "_at", "kind", "title", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_j", "part"))
    titles = F.filter(F.split(F.lower(F.regexp_replace("title", r"\.", "")), " "), lambda t: t != "")
    says = F.when(F.arrays_overlap(titles, F.array(*[F.lit(t.lower()) for t in FEMALE])), "f").when(F.arrays_overlap(titles, F.array(*[F.lit(t.lower()) for t in MALE])), "m")
    gives = (F.col("kind") == "person") & ((F.col("_j") < F.col("_n") - 1) | (F.col("_n") == 1))  # a family name has no gender
    places = staged(places.withColumn("plain", plain_form(F.col("part"), F.col("kind"))).withColumn("_says", F.when(gives, says)), "entity_parts")

    each = places.groupBy("plain", "kind").agg(F.min("_says").alias("_lo"), F.max("_says").alias("_hi"))
    each = each.select("plain", "kind", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("gender"))
    named = assign_surrogates(each, key)
    new = places.join(named, ["plain", "kind"]).withColumn("_new", _rendered(F.col("part"), F.col("kind"), F.col("surrogate")))
    new = new.groupBy("_row", "_at").agg(F.max("kind").alias("kind"), F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("_j", "_new"))).alias("_p"))
    new = new.select("_row", "_at", "kind", F.concat("title", F.array_join("_p._new", " ")).alias("surrogate"))
    new = new.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", "surrogate", "kind"))).alias("_new"))
    built = hit.join(new, "_row")
    made = F.concat_ws("", F.flatten(F.zip_with("_gaps", F.concat(F.col("_new.surrogate"), F.array(F.lit(""))), lambda g, s: F.array(g, s))))
    built = built.select(*[made.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in names], F.size("_new").alias("n_entities"), F.array_sort(F.array_distinct(F.col("_new.kind"))).alias("kinds"))
    return clean.unionByName(built)


def op5_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return replace_personal_data(docs, key="saltmarsh")
