"""Surrogates for personal data, by DataFrame functions alone.

Entities are found by one pattern.  Each is replaced by a keyed permutation of
its own characters: in four rounds the characters at even and odd places are
shifted by a hash of the others, a digit to a digit and a letter to a letter of
its case; then one character is shifted, and the rounds are undone.  Every step
can be undone, so two entities never share a surrogate (distinctness), an entity
has the same one everywhere (coreference), and as the one shift leaves no string
as it is, an entity is not its own surrogate.  Phone and card numbers are permuted
by their digits alone, so spellings of a number keep agreeing; letters count
without case.

A surrogate may be another entity of the table, so surrogates are checked against
the table of distinct entities (of names, their parts) by joins.  One that is an
entity gives way to the next of TURNS permutations whose result neither is an
entity nor taken; texts with such entities get the turns to use by a join on
the text's hash.  Where all turns fail (short names, most of whose spellings
are real) the first surrogate stays, which is distinct all the same; `collisions`
lists these.  Which entities give way depends on the table.
  What makes the type stays: separators, the country code of a
phone, the first digit and the check digit's validity of a card, the top-level
domain of an address, prefixes of keys, four numbers up to 255 of an IP
address, and of names the form of address and the last letter (gender), vowels
staying vowels in Latin, Cyrillic and Greek script.

`entities` lists what was found with its surrogates and `collisions` checks
them: entities that share a surrogate, and surrogates that equal an entity.

Whoever has the key can undo the permutations, so there is no default key.
Patterns repeat groups a bounded number of times or possessively, so a text of
any length and content needs a bounded stack.

Names have any number of parts, and a found part is replaced wherever it stands
in its text; untitled names and scripts without capitals are not found (README).

Defined cases: null and empty texts stay; an entity found twice in a text is
replaced twice alike; rows with equal texts get equal texts; ties between
entities do not arise, as a turn is a permutation; other columns stay as they
are, except n_chars, which follows the text; entity columns already there are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import cut

_PART = r"\p{Lu}(?:[\p{L}’']+|\.(?=[ -]\p{Lu}))?"
_PARTICLE = r"(?:(?:van der|van den|van de|van|von der|von|vom|zu|de la|de las|de los|del|della|de|di|da|dos|du|bin|ibn|al|el|ter|ten)[ -])?"
_NAME = _PARTICLE + _PART + "(?:[ -]" + _PARTICLE + _PART + ")*+"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Srta|Monsieur|Madame|Mme|Mlle|Господин|Госпожа|Κύριος|Κυρία)"
#: In the order in which they are tried.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,10}\p{L}{2,63}",
    "secret": r"""(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,4}[=:]\s{0,4}["']?[A-Za-z0-9_./+-]{6,}""",
    "key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|0[0-9]{2,4}[ /-][0-9]{5,8}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])",
    "ipv6": r"(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "name": _TITLE + r"\.?\s" + _NAME,
}
#: Parts of a found name, which are found wherever they stand in its text.
_HEAD = "^" + _TITLE + r"\.?\s"
_MENTIONED = r"\p{Lu}\p{L}+"
FIND = "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"
#: A text without a match of this has no entity; it is cheaper to try.
HINT = r"[@=:0-9]|AKIA|ASIA|ghp_|sk-|" + _TITLE
#: Letters of names change within a class only (fixed values).
CLASSES = ["aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóú", "ÁÉÍÓÚ", "àèìòù", "ÀÈÌÒÙ", "äëïöü", "ÄËÏÖÜ", "âêîôû", "ÂÊÎÔÛ", "аеиоуыэюя", "АЕИОУЫЭЮЯ", "бвгджзйклмнпрстфхцчшщ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "ΑΕΗΙΟΥΩ", "βγδζθκλμνξπρστφχψ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
#: Digits and letters of IPv6 addresses change within a class only (fixed values).
HEXADECIMAL = ["0123456789", "abcdef", "ABCDEF"]
ROUNDS = 4
TURNS = 4  # further permutations tried for a surrogate that is an entity
SENT = 64 << 20  # bytes of a table that is broadcast, at most


@functools.cache
def _made_up() -> str:
    return secrets.token_hex(16)


def key_of(spark: SparkSession) -> str:
    """The key that the session names; where it names none, one made up for this process."""
    return spark.conf.get("spark.cellweave.pii.secret", None) or _made_up()


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _amount(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i % 31) * 2 + F.lit(1), F.lit(4)), 16, 10).cast("int")


def _plain(c: Column, k: Column) -> Column:
    code = F.ascii(c)
    return F.when(c.between("0", "9"), F.char(48 + F.pmod(code - 48 + k, F.lit(10)))).when(c.between("a", "z"), F.char(97 + F.pmod(code - 97 + k, F.lit(26)))).when(c.between("A", "Z"), F.char(65 + F.pmod(code - 65 + k, F.lit(26)))).otherwise(c)


def _spoken(c: Column, k: Column, classes: list[str] = CLASSES) -> Column:
    out = c
    for letters in classes:
        at = F.position(c, F.lit(letters))
        out = F.when((at > 0) & (c != ""), F.substring(F.lit(letters), F.pmod(at - 1 + k, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
    return out


def _hexadecimal(c: Column, k: Column) -> Column:
    return _spoken(c, k, HEXADECIMAL)


def _step(key: str, salt: str, n: int) -> int:
    """From 1 to n, by the key."""
    return 1 + int(hashlib.sha256(f"{key}|{salt}|step".encode()).hexdigest(), 16) % n


#: The rounds, a step (0) and the rounds undone: as the step leaves no string as it is, neither does the whole.
_ROUNDS = [*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0)]


def _permuted(text: Column, salt: str, key: str, turn: Column, shift=_plain, frozen=None) -> Column:
    """A keyed permutation of the strings with the same classes of characters at each place.

    No string is its own surrogate, unless none of its characters can be shifted.
    """

    def stepped(chars: Column) -> Column:
        free = F.transform(chars, lambda c, i: (shift(c, F.lit(1)) != c) if frozen is None else (shift(c, F.lit(1)) != c) & ~frozen(chars, i))
        # classes have five characters at least
        return _let(F.array_position(free, True), lambda at: F.array_join(F.transform(chars, lambda c, i: F.when(i + 1 == at, shift(c, F.lit(_step(key, salt, 4)))).otherwise(c)), ""))

    def one_round(state: Column, r: Column) -> Column:
        chars = F.split(state, "")
        number = F.abs(r) - 1
        others = F.array_join(F.filter(chars, lambda c, i: (i + number) % 2 == 1), "")
        digest = F.sha2(F.concat(F.lit(f"{key}|{salt}|"), turn, F.lit("|"), number.cast("string"), F.lit("|"), F.lower(others)), 256)

        def turned(h: Column) -> Column:
            def char(c: Column, i: Column) -> Column:
                still = (i + number) % 2 == 1
                return F.when(still if frozen is None else still | frozen(chars, i), c).otherwise(shift(c, F.signum(r).cast("int") * _amount(h, i)))

            return F.array_join(F.transform(chars, char), "")

        return F.when(r == 0, stepped(chars)).otherwise(_let(digest, turned))

    return F.aggregate(F.array(*(F.lit(r) for r in _ROUNDS)), text, one_round)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refilled(m: Column, digits: Column) -> Column:
    """m with its digits replaced, one by one, by others."""
    return F.array_join(F.zip_with(F.split(m, "[0-9]"), F.split(digits, ""), lambda piece, d: F.concat(piece, F.coalesce(d, F.lit("")))), "")


def _check_digit(digits: Column) -> Column:
    """The digit that makes `digits` and itself valid by Luhn's rule."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(from_right, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(m: Column, key: str, turn: Column) -> Column:
    def with_digits(d: Column) -> Column:
        n = F.length(d)
        body = F.substring(d, F.lit(1), n - 1)
        off = F.pmod(F.substring(d, n, F.lit(1)).cast("int") - _check_digit(body), F.lit(10))
        new = F.concat(F.substring(d, 1, 1), _permuted(F.substring(body, F.lit(2), n), "card", key, turn))
        return _let(new, lambda b: _refilled(m, F.concat(b, F.pmod(_check_digit(b) + off, F.lit(10)).cast("string"))))

    return _let(_digits(m), with_digits)


def _phone(m: Column, key: str, turn: Column) -> Column:
    def with_digits(d: Column) -> Column:
        keep = F.when(F.length(d) > 10, F.length(d) - 10).otherwise(F.when(m.startswith("+"), 2).otherwise(0))
        return _refilled(m, F.concat(F.substring(d, F.lit(1), keep), _permuted(F.substring(d, keep + 1, F.length(d)), "phone", key, turn)))

    return _let(_digits(m), with_digits)


def _ip(m: Column, key: str, turn: Column) -> Column:
    def one_round(state: Column, r: Column) -> Column:
        number = F.abs(r) - 1
        others = F.array_join(F.transform(F.filter(state, lambda x, i: (i + number) % 2 == 1), lambda x: x.cast("string")), ".")
        digest = F.sha2(F.concat(F.lit(f"{key}|ip|"), turn, F.lit("|"), number.cast("string"), F.lit("|"), others), 256)
        turned = _let(digest, lambda h: F.transform(state, lambda x, i: F.when((i + number) % 2 == 1, x).otherwise(F.pmod(x + F.signum(r).cast("int") * _amount(h, i), F.lit(256)))))
        return F.when(r == 0, F.transform(state, lambda x, i: F.when(i == 0, (x + _step(key, "ip", 255)) % 256).otherwise(x))).otherwise(turned)

    numbers = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(F.aggregate(F.array(*(F.lit(r) for r in _ROUNDS)), numbers, one_round), lambda x: x.cast("string")), ".")


def _after(m: Column, prefix: str, salt: str, key: str, turn: Column, **how) -> Column:
    """The permutation of what follows a prefix."""
    return _let(F.regexp_extract(m, "^" + prefix, 0), lambda head: F.concat(head, _permuted(F.substring(m, F.length(head) + 1, F.length(m)), salt, key, turn, **how)))


def _name_part(w: Column, key: str, turn: Column) -> Column:
    last = lambda chars, i: (i > 0) & (i == F.size(chars) - 1)
    return _permuted(w, "name", key, turn, shift=_spoken, frozen=last)


def _name(m: Column, key: str, turn_of) -> Column:
    """Each part by itself, so it is the same in all names and mentions; particles stay."""
    part = lambda w: F.when(w.rlike(r"^\p{Lu}"), _name_part(w, key, turn_of("name", F.lower(w)))).otherwise(w)
    head = F.regexp_extract(m, _HEAD, 0)

    def parted(h: Column) -> Column:
        tail = F.substring(m, F.length(h) + 1, F.length(m))
        return F.concat(h, F.array_join(F.zip_with(F.split(tail, r"\p{L}+", -1), F.transform(F.regexp_extract_all(tail, F.lit(r"\p{L}+"), F.lit(0)), part), lambda piece, w: F.concat(piece, F.coalesce(w, F.lit("")))), ""))

    return _let(head, parted)


def kind(m: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _unit(name: str, m: Column) -> Column:
    """What spellings of an entity have in common."""
    if name == "phone":
        return F.concat(F.when(m.startswith("+"), "+").otherwise(""), _digits(m))
    return _digits(m) if name in ("card", "ssn") else F.lower(m) if name == "email" else m


def _by_kind(m: Column, key: str, turn_of) -> dict[str, Column]:
    """The surrogate of an entity as of each kind but names; turn_of(kind, unit) is the permutation to take."""
    turn = {name: turn_of(name, _unit(name, m)) for name in PATTERNS}
    return {
        "email": _let(F.regexp_extract(m, r"\.\p{L}+$", 0), lambda tail: F.concat(_permuted(F.substring(m, F.lit(1), F.length(m) - F.length(tail)), "email", key, turn["email"]), tail)),
        "secret": _after(m, r"""[^=:]*[=:]\s*["']?""", "secret", key, turn["secret"]),
        "key": _after(m, r"(?:AKIA|ASIA|ghp_|sk-)", "key", key, turn["key"]),
        "iban": _after(m, "[A-Z]{2}", "iban", key, turn["iban"]),
        "card": _card(m, key, turn["card"]),
        "phone": _phone(m, key, turn["phone"]),
        "ssn": _let(_digits(m), lambda d: _refilled(m, _permuted(d, "ssn", key, turn["ssn"]))),
        "ip": _ip(m, key, turn["ip"]),
        "ipv6": _permuted(m, "ipv6", key, turn["ipv6"], shift=_hexadecimal),
    }


def _chosen(k: Column, by_kind: dict[str, Column], otherwise: Column) -> Column:
    for name, value in reversed(by_kind.items()):
        otherwise = F.when(k == name, value).otherwise(otherwise)
    return otherwise


def surrogate(m: Column, key: str, turns: Column | None = None) -> Column:
    """The surrogate of an entity; `turns`: map from "kind:unit" to the permutation that it takes, if not the first."""

    def turn_of(name: str, unit: Column) -> Column:
        return F.lit("0") if turns is None else F.coalesce(F.element_at(turns, F.concat(F.lit(f"{name}:"), unit)), F.lit(0)).cast("string")

    return _let(kind(m), lambda k: _chosen(k, _by_kind(m, key, turn_of), _name(m, key, turn_of)))


def _units(m: Column) -> Column:
    """The "kind:unit" of an entity; of a name, of each part."""
    tail = F.regexp_replace(m, _HEAD, "")
    parts = F.transform(F.filter(F.regexp_extract_all(tail, F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.concat(F.lit("name:"), F.lower(w)))
    return _let(kind(m), lambda k: F.when(k == "name", parts).otherwise(F.array(F.concat(k, F.lit(":"), _chosen(k, {name: _unit(name, m) for name in PATTERNS if _unit(name, m) is not m}, m)))))


def _unit_surrogate(unit: Column, key: str, turn: int) -> Column:
    """The "kind:unit" that takes the place of one."""
    k, u = F.substring_index(unit, ":", 1), F.regexp_replace(unit, "^[a-z0-9]*:", "")
    turn_of = lambda *_: F.lit(str(turn))
    by_kind = {name: _unit(name, x) for name, x in _by_kind(u, key, turn_of).items()}
    return F.concat(k, F.lit(":"), _chosen(k, by_kind, _name_part(u, key, F.lit(str(turn)))))


def turns_of(units: DataFrame, key: str) -> DataFrame:
    """(unit, turn) of the distinct units whose first surrogate is a unit, as far as a turn helps."""
    taken = cut(units.select("unit", _unit_surrogate(F.col("unit"), key, 0).alias("s")))
    real = units.select(F.col("unit").alias("s"))
    left = cut(taken.join(real, "s", "left_semi").select("unit"))
    taken = taken.select("s")
    out = left.select("unit", F.lit(0).alias("turn")).limit(0)
    for turn in range(1, TURNS + 1):
        if left.isEmpty():
            break
        tried = left.select("unit", _unit_surrogate(F.col("unit"), key, turn).alias("s"))
        good = cut(tried.join(real, "s", "left_anti").join(taken, "s", "left_anti").select("unit", F.lit(turn).alias("turn"), "s"))
        out, taken = out.unionByName(good.select("unit", "turn")), taken.unionByName(good.select("s"))
        left = cut(left.join(good, "unit", "left_anti"))
    return out


def _found(docs: DataFrame) -> DataFrame:
    """Adds _find, the pattern of the text's entities, and _found, the entities."""
    none = F.array().cast("array<string>")
    rows = docs.withColumn("_found", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(FIND), F.lit(0))).otherwise(none))
    names = F.filter("_found", lambda m: m.rlike(_HEAD))
    parts = F.array_distinct(F.flatten(F.transform(names, lambda m: F.regexp_extract_all(F.regexp_replace(m, _HEAD, ""), F.lit(_MENTIONED), F.lit(0)))))
    rows = rows.withColumn("_parts", parts)
    again = F.concat(F.lit(FIND + r"|(?<![\p{L}\p{N}])(?:"), F.array_join("_parts", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    rows = rows.withColumn("_find", F.when(F.size("_parts") > 0, again).otherwise(F.lit(FIND)))
    return rows.withColumn("_found", F.when(F.size("_parts") > 0, F.regexp_extract_all("text", F.col("_find"), F.lit(0))).otherwise(F.col("_found"))).drop("_parts")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All rows and columns of `docs` with surrogates in `text`, and n_entities and entity_kinds."""
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop("n_entities", "entity_kinds")
    held = cut(_found(docs.select("text")).select(F.xxhash64("text").alias("_of"), F.explode(F.array_distinct(F.flatten(F.transform("_found", _units)))).alias("unit")).distinct())
    turns = cut(turns_of(held.select("unit").distinct(), key))
    turns = held.join(turns, "unit").groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("unit", "turn"))).alias("_turns"))
    turns = cut(turns)
    rows = _found(docs).withColumns({"n_entities": F.size("_found").cast("long"), "entity_kinds": F.transform("_found", kind)})
    if turns.isEmpty():
        rows = rows.withColumn("_new", F.transform("_found", lambda m: surrogate(m, key)))
    else:
        length = turns.agg(F.sum(F.length(F.to_json("_turns")) + 64)).first()[0]
        rows = rows.join(F.broadcast(turns) if length <= SENT else turns, F.xxhash64("text") == F.col("_of"), "left")
        rows = rows.withColumn("_new", F.transform("_found", lambda m: surrogate(m, key, F.col("_turns")))).drop("_of", "_turns")
    new = F.array_join(F.zip_with(F.split("text", F.col("_find"), -1), F.col("_new"), lambda piece, s: F.concat(piece, F.coalesce(s, F.lit("")))), "")
    rows = rows.withColumn("text", F.when(F.size("_found") > 0, new).otherwise(F.col("text"))).drop("_found", "_find", "_new")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows


def entities(docs: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate, n): each distinct entity of the texts, with its first surrogate."""
    each = _found(docs.select("text")).select(F.explode("_found").alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))
    return each.select(kind(F.col("entity")).alias("kind"), "entity", surrogate(F.col("entity"), key).alias("surrogate"), "n")


def collisions(found: DataFrame) -> DataFrame:
    """Entities that share a surrogate (apart from case), and surrogates that are entities."""
    shared = found.groupBy("kind", F.lower("surrogate").alias("surrogate")).agg(F.countDistinct(F.lower("entity")).alias("n")).where("n > 1").select("kind", "surrogate", F.lit("shared").alias("why"))
    real = found.select("kind", "surrogate").join(found.select(F.col("entity").alias("surrogate")), "surrogate", "left_semi").select("kind", "surrogate", F.lit("an entity").alias("why"))
    return shared.unionByName(real)
