"""Personal data to keyed surrogates, as column expressions only.

Found: e-mail addresses, IPv4 and IPv6 addresses, social security numbers,
IBANs, payment cards, phone numbers, street addresses, and names: after an
honorific, or a known given name with a capitalised word behind it.  Every
capitalised word of such a name is then a name throughout the text, with or
without what announced it first.

A surrogate depends on the entity and the key alone, so an entity has the same
one everywhere, in any formatting of its digits and any case, and each part of
a name or of an address keeps its own.  Distinct entities of a form stay
distinct, as every step is a permutation:

* A known given name becomes another one of its list, that is of its gender and
  script; the lists are shuffled by the key.
* Other characters move within their alphabet (digits; vowels and consonants of
  a script, case kept) by an amount that a keyed SHA-256 of the characters
  before gives, which can be undone from the left.  The first always moves; the
  last letter of a name, which often carries gender, stays.  A word that turns
  into a known given name moves on, so the two ways never meet.
* Octets move modulo 256.  Numbers of a social security number move within the
  ranges the registry issues.  A card and an IBAN keep the validity of their
  check digits, a phone its country code, a street its kind.  A mail domain gets
  its own surrogate, the same for all its users, under a reserved name.

What none of this moves becomes a keyed word instead, so no surrogate is its
original.  ``n_collisions`` checks per text that distinct entities stayed
distinct.  The caller gives the key; whoever has it can undo the surrogates.

Defined edge cases: null text stays null; texts without entities come back
unchanged; repeated rows are each returned; ``redact`` leaves other columns as
they are, but for ``n_chars``, which follows the text where it exists.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let, replace

#: Session setting with the key.
KEY = "spark.graphloom.surrogateKey"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Honorifics that announce a name, in several languages.
HONORIFICS = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Señorita", "Sr", "Sra", "Signor", "Signora", "Господин", "Госпожа", "Κύριος", "Κυρία"]
#: Given names by gender and script.
GIVEN = {
    "female latin": ["Alice", "Anna", "Barbara", "Carla", "Claire", "Emma", "Eva", "Helena", "Ingrid", "Isabel", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nina", "Olga", "Paula", "Sofia", "Teresa"],
    "male latin": ["Albert", "Anton", "Carlos", "Daniel", "David", "Erik", "Felix", "Hugo", "Ivan", "Jacob", "James", "John", "Lucas", "Martin", "Miguel", "Oscar", "Paul", "Peter", "Robert", "Thomas"],
    "female cyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София", "Юлия"],
    "male cyrillic": ["Алексей", "Антон", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Олег", "Павел", "Сергей"],
    "female greek": ["Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
    "male greek": ["Γιάννης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
KNOWN = [n.lower() for some in GIVEN.values() for n in some]
#: A word moves on at most as often as there are given names of one length and last letter.
WALK = 1 + max(Counter((len(n), n[-1]) for n in KNOWN).values())

STREETS = ["Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Ct", "Square", "Sq"]
ENDINGS = ["straße", "strasse", "gasse", "platz", "weg", "allee"]
ROADS = ["rue", "avenue", "boulevard", "place"]
WAYS = ["Calle", "Avenida", "Plaza"]

WORD = r"\p{Lu}[\p{L}'-]++"
TITLED = r"(?<!\p{L})(?:" + "|".join(HONORIFICS) + r")\.?\x20" + WORD + r"(?:\x20" + WORD + "){0,2}"
CALLED = r"(?<!\p{L})(?=\p{Lu})(?:" + "|".join(n for some in GIVEN.values() for n in some) + r")\x20" + WORD + r"(?:\x20" + WORD + ")?"
HEX = "[0-9A-Fa-f]{1,4}"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{2,6}}(?::{HEX}){{1,5}}|(?=[A-Fa-f]{{0,3}}[0-9])[0-9A-Fa-f]{{4}}:(?::{HEX}){{1,5}})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])",
    "street": r"(?<![\p{L}0-9])[0-9]{1,5}\x20(?:\p{Lu}[\p{L}'-]*+\x20){1,3}(?:" + "|".join(STREETS) + r")(?!\p{L})"
    + r"|(?<!\p{L})\p{Lu}\p{Ll}{1,40}(?:" + "|".join(ENDINGS) + r")\x20[0-9]{1,4}(?![\p{L}0-9])"
    + r"|(?<![\p{L}0-9])[0-9]{1,5},?\x20(?:" + "|".join(ROADS) + r")\x20(?:de\x20(?:la\x20)?|du\x20|des\x20)?" + WORD
    + r"|(?<!\p{L})(?:" + "|".join(WAYS) + r")\x20" + WORD + r",?\x20[0-9]{1,5}(?![0-9])",
    "name": f"{TITLED}|{CALLED}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: The same, and every capitalised word, for texts in which names were found.
WITH_WORDS = PATTERN + r"|(?<!\p{L})" + WORD
#: Admits every text that PATTERN can match in.
GUARD = (
    r"[0-9][0-9. -]|@|\([0-9]|::|:[0-9A-Fa-f]{1,4}:|(?:" + "|".join(ENDINGS) + r")\x20[0-9]|[0-9],?\x20(?:" + "|".join(ROADS) + r")\x20|(?:" + "|".join(WAYS) + r")\x20\p{Lu}"
    + r"|(?<!\p{L})(?:" + "|".join(HONORIFICS) + r")\.?\x20\p{Lu}|" + CALLED
)
RESERVED = r"\.example\.(?:com|org|net)$|\.(?:example|invalid)$"

#: Letters of a script that are vowels once their marks are taken off.
VOWELS = set("aeiouyæœøıαεηιυοωаеиоуыэюяіѣѵаэըաեէիոօ")
#: First and last code points of the scripts with case.
SCRIPTS = [(0xDF, 0x17F), (0x180, 0x24F), (0x1E00, 0x1EFF), (0x3AC, 0x3CE), (0x1F00, 0x1FFC), (0x430, 0x45F), (0x460, 0x52F), (0x561, 0x586)]


def alphabets() -> list[str]:
    """Alphabets whose letters change places with each other: one of vowels and one of the rest per script."""
    out = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz"]
    for first, last in SCRIPTS:
        letters = [chr(c) for c in range(first, last + 1)]
        letters = [c for c in letters if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c]
        for vowels in (True, False):
            some = "".join(c for c in letters if (unicodedata.normalize("NFD", c)[0] in VOWELS) is vowels)
            out += [some] if len(some) > 1 else []
    return out


ALPHABETS = alphabets()
HEXADECIMAL = ["0123456789abcdef"]
#: Characters before one that its step depends on.
REACH = 32


def key_of(spark: SparkSession) -> str:
    """The key in ``KEY`` of the session; where there is none, a random one, which the session then keeps."""
    from secrets import token_hex

    found = spark.conf.get(KEY, None)
    if not found:
        spark.conf.set(KEY, found := token_hex(32))
    return found


def _step(key: str, domain: str, before: Column, n: Column | int, first: Column) -> Column:
    """A keyed number below n from the characters before; never 0 for the first."""
    keyed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{domain}|"), before, F.lit(f"|{key}")), 256), 1, 13), 16, 10).cast("long")
    one = first.cast("int")
    return (keyed % (n - one) + one).cast("int")


def _moved(c: Column, key: str, domain: str, before: Column, some: list[str]) -> Column:
    """One character within its alphabet; the first character of an entity always moves."""
    low = F.lower(c)

    def within(letters: Column) -> Column:
        new = F.substr(letters, (F.instr(letters, low) - 1 + _step(key, domain, before, F.length(letters), before == "")) % F.length(letters) + 1, F.lit(1))
        return F.when(letters.isNull(), c).when(c == low, new).otherwise(F.upper(new))

    return let(F.get(F.filter(F.array(*map(F.lit, some)), lambda a: F.contains(a, low)), 0), within)


def _mapped(text: Column, key: str, domain: str, some: list[str] | None = None) -> Column:
    """Every character moved; what comes before counts without case."""

    def moved(characters: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.lower(F.array_join(F.slice(characters, F.greatest(i - REACH + 1, F.lit(1)), F.least(i, F.lit(REACH))), ""))
            return _moved(c, key, domain, before, some or ALPHABETS[:3])

        return F.array_join(F.transform(characters, one), "")

    return let(F.split(text, ""), moved)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _renumbered(text: Column, digits: Column, skip: Column) -> Column:
    """The digits of the text, after the first ``skip``, replaced by ``digits`` in turn."""

    def put(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substr(text, F.lit(1), i + 1)))
        return F.when(F.regexp_like(c, F.lit("[0-9]")) & (nth > skip), F.substr(digits, nth - skip, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), put), "")


def _luhn(digits: Column, n: Column) -> Column:
    """Checksum of the digits as the first ones of a number of n + 1 digits."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda s, x: s + x)


def _card(text: Column, key: str) -> Column:
    def with_digits(d: Column) -> Column:
        n = F.length(d) - 1
        payload, check = F.substr(d, F.lit(1), n), F.substr(d, n + 1, F.lit(1)).cast("int")
        moved = _mapped(payload, key, "card")
        return let(moved, lambda p: _renumbered(text, F.concat(p, F.pmod(check + _luhn(payload, n) - _luhn(p, n), F.lit(10)).cast("string")), F.lit(0)))

    return let(_digits(text), with_digits)


def _remainder(text: Column) -> Column:
    """The text as a number modulo 97, letters as 10 to 35."""

    def one(s: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, (s * 100 + letter) % 97).otherwise((s * 10 + c.cast("int")) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _iban(text: Column, key: str) -> Column:
    """Country and spaces stay, the account moves, and the check digits are as far from right as they were."""

    def with_bare(bare: Column) -> Column:
        country, check, account = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(3), F.lit(2)).cast("int"), F.substr(bare, F.lit(5))

        def right(a: Column) -> Column:
            return F.lit(98) - _remainder(F.concat(a, country, F.lit("00")))

        def with_moved(a: Column) -> Column:
            whole = F.concat(country, F.lpad(F.pmod(right(a) + check - right(account), F.lit(100)).cast("string"), 2, "0"), a)

            def put(c: Column, i: Column) -> Column:
                return F.when(c == " ", c).otherwise(F.substr(whole, F.length(F.replace(F.substr(text, F.lit(1), i + 1), F.lit(" "))), F.lit(1)))

            return F.array_join(F.transform(F.split(text, ""), put), "")

        return let(_mapped(account, key, "iban"), with_moved)

    return let(F.replace(text, F.lit(" ")), with_bare)


def _phone(text: Column, key: str) -> Column:
    code = F.when(text.startswith("+"), F.greatest(F.length(F.regexp_extract(text, r"^\+([0-9]{1,3})[ .(-]", 1)), F.lit(1))).otherwise(0)
    return let(code, lambda skip: let(F.substr(_digits(text), skip + 1), lambda d: _renumbered(text, _mapped(d, key, "phone"), skip)))


def _ip(text: Column, key: str) -> Column:
    octets = F.split(text, "[.]")

    def one(o: Column, i: Column) -> Column:
        before = F.array_join(F.slice(octets, F.lit(1), i), ".")
        return ((o.cast("int") + _step(key, "ip", before, 256, i == 0)) % 256).cast("string")

    return F.array_join(F.transform(octets, one), ".")


def _ssn(text: Column, key: str) -> Column:
    """Area, group and serial number within what is issued; an area that isn't (000, 666, 9xx) stays, and so does an unissued 00 or 0000."""
    area, group, serial = (F.substring(text, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    issued = (area > 0) & (area < 900) & (area != 666)
    nth = (area - 1 - (area > 666).cast("int") + _step(key, "ssn", F.lit(""), 898, F.lit(True))) % 898 + 1
    new = F.when(issued, nth + (nth >= 666).cast("int")).otherwise(area)

    def within(number: Column, n: int, before: Column, first: Column) -> Column:
        return F.when(number > 0, (number - 1 + _step(key, "ssn", before, n, first)) % n + 1).otherwise(number)

    parts = [(new, 3), (within(group, 99, F.substring(text, 1, 3), ~issued), 2), (within(serial, 9999, F.substring(text, 1, 6), F.lit(False)), 4)]
    return F.concat_ws("-", *(F.lpad(n.cast("string"), size, "0") for n, size in parts))


def _email(text: Column, key: str) -> Column:
    name = F.substring_index(text, "@", 1)
    domain = F.substring_index(text, "@", -1)
    kept = F.regexp_extract(domain, f"(?i:{RESERVED})", 0)
    own = F.when(kept != "", F.concat(_mapped(F.substr(domain, F.lit(1), F.length(domain) - F.length(kept)), key, "domain"), kept)).otherwise(F.concat(_mapped(domain, key, "domain"), F.lit(".test")))
    return F.concat(_mapped(name, key, "email"), F.lit("@"), own)


def _word(w: Column, key: str) -> Column:
    """One word of a name."""
    partner = {}
    for kind, some in GIVEN.items():
        order = sorted(some, key=lambda n: hashlib.sha256(f"{key}|{kind}|{n}".encode()).digest())
        partner |= {n.lower(): order[(i + 1) % len(order)] for i, n in enumerate(order)}
    n = F.length(w)

    def moved(w: Column, i: Column) -> Column:
        whole = _mapped(w, key, "name", ALPHABETS)
        return F.when((i == 0) | F.lower(w).isin(KNOWN), F.when(n < 3, whole).otherwise(F.concat(F.substr(whole, F.lit(1), n - 1), F.substr(w, n, F.lit(1))))).otherwise(w)

    place = F.array_position(F.array(*map(F.lit, KNOWN)), F.lower(w))
    given = F.get(F.array(*[F.lit(partner[k]) for k in KNOWN]), place.cast("int") - 1)
    return F.when(place > 0, F.when((w == F.upper(w)) & (n > 1), F.upper(given)).otherwise(given)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), w, moved))


def _is_title(w: Column) -> Column:
    return F.regexp_like(w, F.lit("^(?:" + "|".join(HONORIFICS) + r")\.?$"))


def _name(text: Column, key: str) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w, i: F.when((i == 0) & _is_title(w), w).otherwise(_word(w, key))), " ")


def _street(text: Column, key: str) -> Column:
    """Numbers and names move, what says the kind of street stays."""
    same = [*STREETS, *ROADS, *WAYS]
    ending = "(?:" + "|".join(ENDINGS) + ")$"

    def one(w: Column) -> Column:
        kept = F.regexp_extract(w, ending, 0)
        return (
            F.when(F.regexp_like(w, F.lit("^[0-9]")), _mapped(w, key, "street", ALPHABETS[:1])).when(w.isin(same) | F.regexp_like(w, F.lit(r"^\p{Ll}")), w)
            .otherwise(F.concat(_mapped(F.substr(w, F.lit(1), F.length(w) - F.length(kept)), key, "street", ALPHABETS), kept))
        )

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def kind_of(entity: Column) -> Column:
    def like(name: str) -> Column:
        return F.regexp_like(entity, F.lit(f"^(?:{KINDS[name]})$"))

    out = F.when(F.contains(entity, F.lit("@")), "email").when(like("ip"), "ip").when(F.contains(entity, F.lit(":")), "ipv6").when(like("ssn"), "ssn").when(like("iban"), "iban").when(like("street"), "street")
    return out.when(F.regexp_like(entity, F.lit(r"^\p{L}")), "name").when(~entity.startswith("+") & (F.length(_digits(entity)) >= 13), "card").otherwise("phone")


def surrogate(entity: Column, key: str) -> Column:
    def of(kind: Column) -> Column:
        made = F.when(kind == "email", _email(entity, key)).when(kind == "ip", _ip(entity, key)).when(kind == "ipv6", _mapped(entity, key, "ipv6", HEXADECIMAL)).when(kind == "card", _card(entity, key))
        made = made.when(kind == "name", _name(entity, key)).when(kind == "iban", _iban(entity, key)).when(kind == "street", _street(entity, key)).when(kind == "ssn", _ssn(entity, key)).otherwise(_phone(entity, key))
        digest = F.sha2(F.concat(F.lit(f"{key}|word|"), F.lower(entity), F.lit(f"|{key}")), 256)
        return let(made, lambda m: F.when(m == entity, F.initcap(F.translate(F.substring(digest, 1, 12), "0123456789abcdef", "bcdfghjklmnpqrst"))).otherwise(m))

    return let(kind_of(entity), of)


def _known_words(text: Column) -> Column:
    """Words of the names found in the text, lower-cased, dealt by hash into lists of some 32."""
    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(KINDS["name"]), F.lit(0)), lambda e: F.filter(F.split(e, " "), lambda w: ~_is_title(w))))

    def dealt(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / 32).cast("int")), lambda b: F.filter(w, lambda x: F.pmod(F.hash(x), F.floor(F.size(w) / 32).cast("int") + 1) == b))

    return let(F.array_distinct(F.transform(words, F.lower)), dealt)


def surrogates(text: Column, key: str) -> Column:
    """struct(found, made, text) of a text; null if it has nothing to find.  A word that is no name is made itself."""
    single = F.lit(r"^\p{Lu}[\p{L}'-]++$")

    def with_names(known: Column) -> Column:
        def is_known(w: Column) -> Column:
            return F.array_contains(F.get(known, F.pmod(F.hash(F.lower(w)), F.size(known))), F.lower(w))

        def change(e: Column) -> Column:
            return F.when(F.regexp_like(e, single), F.when(is_known(e), _word(e, key)).otherwise(e)).otherwise(surrogate(e, key))

        return replace(text, F.when(F.size(F.flatten(known)) > 0, WITH_WORDS).otherwise(PATTERN), change)

    return F.when(F.regexp_like(text, F.lit(GUARD)), let(_known_words(text), with_names))


def annotate(docs: DataFrame, *, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: entities by kind, collisions (0), and the text with surrogates."""

    def count(kinds: Column, name: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == name)).cast("long")

    def report(pairs: Column) -> Column:
        def bare(value: Callable[[Column], Column]) -> Column:
            def plain(p: Column) -> Column:
                number = F.concat(F.when(value(p).startswith("+"), "+").otherwise(""), _digits(value(p)))
                return F.struct(p["kind"], F.when(p["kind"].isin("card", "phone", "ssn"), number).otherwise(F.lower(F.replace(value(p), F.lit(" ")))))

            return F.size(F.array_distinct(F.transform(pairs, plain)))

        kinds = F.transform(pairs, lambda p: p["kind"])
        columns = [count(kinds, name).alias(f"n_{name}") for name in KINDS]
        return F.struct(*columns, (bare(lambda p: p["found"]) - bare(lambda p: p["made"])).cast("long").alias("n_collisions"))

    def changed(s: Column) -> Column:
        pairs = F.transform(s["found"], lambda x, i: F.struct(x.alias("found"), F.get(s["made"], i).alias("made")))
        return F.transform(F.filter(pairs, lambda p: p["found"] != p["made"]), lambda p: F.struct(kind_of(p["found"]).alias("kind"), p["found"].alias("found"), p["made"].alias("made")))

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("_text"), surrogates(F.col(text_column), key).alias("_s"))
    rows = source.select("doc_id", "_text", F.col("_s.text").alias("_made"), F.when(F.col("_s").isNotNull(), let(changed(F.col("_s")), report)).alias("_r"))
    counts = [F.coalesce(F.col(f"_r.{c}"), F.lit(0)).alias(c) for c in [*(f"n_{k}" for k in KINDS), "n_collisions"]]
    return rows.select("doc_id", *counts, F.coalesce("_made", "_text").alias("text"))


def redact(docs: DataFrame, *, key: str, text_column: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, all columns."""
    done = docs.withColumn(text_column, F.coalesce(surrogates(F.col(text_column), key)["text"], F.col(text_column)))
    return done.withColumn("n_chars", F.length(text_column).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
