"""Personal data replaced by keyed surrogates of the same type.

Entities are found by pattern: e-mail addresses, phone numbers, IPv4 addresses, long digit runs (cards, accounts),
secrets assigned to a name, and persons: names after a title, after words that announce one, and after a known given name.
A surrogate is drawn from an HMAC of the entity's canonical form, so the same entity has the same surrogate in every
document and run under one key. It keeps the format: digits stay digits, hexadecimal stays so, case, length and punctuation
stay, a card number that passes the Luhn check passes it, an address stays an address, a name keeps its gender, script and
number of words. The parts of a name are entities of their own: a family has one surrogate with and without given names,
and a given name in a family one gender, which most of its mentions in the corpus give, whatever the title of one.

Distinct entities must not meet in one surrogate, nor a surrogate be another entity of the corpus. The distinct entities
are checked over the whole corpus: a group that shares a surrogate leaves it to its first member, and a surrogate that
is an entity goes, and the others draw again until none collides; surrogates get longer with the draws, so that they aren't
used up. Only those that drew again are passed to the documents that hold them; the rest is drawn in place.

Patterns run once over the texts. What is written in between holds places, keyed hashes, and entities enciphered under the
key, and the latter are deleted when the draws are done.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintra.llm.common import Scratch, free

# Titles by gender, given names by script and gender, and syllables of family names by script.
TITLES = {
    "m": "Mr Mister Herr Herrn Señor Sr Don Monsieur Signor Господин Г-н",
    "f": "Mrs Ms Miss Frau Señora Señorita Sra Srta Doña Madame Mademoiselle Mme Mlle Signora Госпожа Г-жа",
    "n": "Dr Prof Professor Doktor Doctor Docteur Mx Доктор",
}
GIVEN = {
    ("latin", "m"): "Adam Albert Alexander Andreas Antonio Arthur Bruno Carl Carlos Charles Christopher Daniel David Diego Edward Emil Felix François Frank Georg George Hans Harry Henri Henry Ivan Jack James Jean John Jonas José Juan Karl Kevin Leo Louis Luis Manuel Mark Martin Michael Miguel Nils Oscar Pablo Paul Pedro Peter Pierre Richard Robert Simon Stefan Stephen Thomas Victor Walter William Wolfgang",
    ("latin", "f"): "Agnes Alice Amelia Ana Anna Anne Barbara Bella Camille Carmen Caroline Catherine Charlotte Christine Clara Diana Dorothy Elena Elizabeth Emily Emma Eva Flora Greta Hannah Helena Ingrid Irene Isabel Jane Jennifer Julia Karen Klara Laura Linda Lucía Margaret Maria Marie Mary Monika Nancy Nina Olga Paula Petra Rosa Sabine Sandra Sara Sofia Sophie Susan Teresa Ursula Vera Victoria",
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Иван Кирилл Лев Максим Олег Павел Роман Семён Тимур Фёдор",
    ("cyrillic", "f"): "Алина Вера Галина Дарья Елена Жанна Ирина Ксения Лидия Марина Нина Ольга Полина Раиса Софья",
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μάρκος Νίκος Πέτρος",
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
}
SYLLABLES = {"latin": "bar del fen gor hal jan kel lor man nov pel ris sol tar ven wes", "cyrillic": "бар вел гор дан жел кам лев мир нов пет рос сол тер ход шан юр", "greek": "βαρ γερ δελ ζαν θεο καρ λαμ μαν νικ παπ ραλ σαβ ταρ φιλ χαν ψαρ"}

GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
GIVEN_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names.split()}
CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΫЀ-Я"
#: A name, without the 's of a genitive.
NAME = rf"[{CAPITAL}][^\W\d_]+(?:[-'’](?!s(?!\w))[^\W\d_]+)*"
#: Words that announce a person's name (fixed values).
CUES = "name is|name:|full name:|dear|signed by|sincerely,|kind regards,|contact person:|attn:|ich heiße|mein name ist|name ist|liebe|lieber|je m'appelle|nom :|nom:|me llamo|mi nombre es|nombre:|меня зовут|имя:"
TITLE = "|".join(sorted(GENDER, key=len, reverse=True))
KNOWN = "|".join(sorted(GIVEN_GENDER, key=len, reverse=True))
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|(?<![\w.%+-])[^\W_][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:(?<=\btoken = \")|(?<=\btoken=\")|(?<=\bkey = \")|(?<=\bkey=\")|(?<=\bsecret = \")|(?<=\bsecret=\")|(?<=\bpassword = \")|(?<=\bpassword=\"))[^\"\s]{6,}(?=\")|\b[0-9a-f]{32,64}\b|\b[0-9A-F]{32,64}\b",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,5}){2,5}(?!\d)|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "number": r"(?<![\w.])\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?(?!\w)|(?<![\w.])\d{9,19}(?!\w)|\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "person": rf"(?:(?<=\s)|(?<=^))(?:{TITLE})\.? {NAME}(?: {NAME})?",
    "announced": rf"(?<!\w)(?i:{CUES})\s{NAME} {NAME}",
    "known": rf"(?<![\w'’-])(?=[{CAPITAL}])(?:{KNOWN}) {NAME}",
}
ENTITY = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
#: What every entity has one of: a digit, an @, a quote, hexadecimal letters, a title, a known given name or a cue. Texts without
#: are not searched. For Java, whose \d and \s know ASCII only, where Python's know all digits and spaces.
HINT = rf"[\p{{Nd}}@\"]|[a-fA-F]{{32}}|(?<![\p{{L}}\p{{N}}_])(?=\p{{Lu}})({TITLE}|{KNOWN})\.? |(?iu)(?<![\p{{L}}\p{{N}}_])({CUES})[\s\x1c-\x1f\x85\p{{Z}}]"


def entities(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of a text's entities, in order and apart. A person's are the name's, without title and cue; the kind has its gender."""
    for m in ENTITY.finditer(text or ""):
        kind, start, found = m.lastgroup, m.start(), m.group()
        if kind == "person":
            start += found.index(" ") + 1
            kind = f"person-{gender(found)}"
        elif kind == "announced":
            start += len(found) - len(" ".join(found.split()[-2:]))
            kind = f"person-{GIVEN_GENDER.get(found.split()[-2], 'n')}"
        elif kind == "known":
            kind = f"person-{GIVEN_GENDER[found.split(' ')[0]]}"
        yield start, m.end(), kind


def gender(titled: str) -> str:
    title, given = titled.split(" ")[:2]
    g = GENDER[title.rstrip(".")]
    return g if g != "n" else GIVEN_GENDER.get(given, "n")


def parts(kind: str, entity: str) -> list[tuple[str, str, str]]:
    """(kind, text, canonical form) of what an entity consists of. A person: the family, and the given name in it with its gender.
    Addresses, secrets in hexadecimal and names are one by letters, numbers by their digits and format."""
    base, _, sex = kind.partition("-")
    if base != "person":
        return [(kind, entity, f"{kind}:{entity.lower() if kind in ('email', 'secret') else entity}")]
    *given, family = entity.split(" ")
    low = family.lower()
    return [("family", family, f"family:{low}"), *((f"given-{sex}", f"{g} {family}", f"given:{g.lower()} {low}") for g in given)]


def named(key: bytes, form: str) -> bytes:
    """The keyed hash that stands for a canonical form."""
    return hmac.new(key, form.encode(), hashlib.sha256).digest()[:16]


def sealed(key: bytes, name: bytes, text: bytes) -> bytes:
    """text enciphered by a key stream of its entity, or what was so deciphered."""
    stream = b"".join(hmac.new(key, b"seal:%d:" % k + name, hashlib.sha256).digest() for k in range(-(-len(text) // 32)))
    return bytes(x ^ y for x, y in zip(text, stream, strict=False))


class Draw:
    """Endless keyed random numbers for one entity and attempt."""

    def __init__(self, key: bytes, name: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{attempt}:{name}".encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 16:
            block = hmac.new(self.key, self.seed + b":%d" % self.n, hashlib.sha256).digest()
            self.pool, self.left, self.n = int.from_bytes(block, "big"), 256, self.n + 1
        value, self.pool, self.left = (self.pool & 0xFFFF) % n, self.pool >> 16, self.left - 16
        return value


def luhn(digits: list[int]) -> int:
    """0 for digits that pass the check."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10


def reshaped(entity: str, draw: Draw, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Digits for digits, letters for letters of the same case; the rest stays."""
    return "".join(str(draw.below(10)) if c.isdigit() else (x := letters[draw.below(len(letters))], x.upper() if c.isupper() else x)[1] if c.isalpha() else c for c in entity)


def script(name: str) -> str:
    c = next((c for c in name if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def drawn_part(key: bytes, kind: str, entity: str, form: str, attempt: int = 0) -> str:
    """The surrogate of a part (see parts) at an attempt; mentions of one entity in another case get it in their case."""
    draw = Draw(key, form, attempt)
    base, _, sex = kind.partition("-")
    # formats of a fixed length keep it for three rounds of eight draws
    longer = "0" * max(0, attempt // 8 - 2)
    if base == "email":
        local, domain = entity.rsplit("@", 1)
        labels = domain.split(".")
        # the registered name changes, what stands for the network's part (.example.com, .org) stays
        fixed = 2 if len(labels) > 2 and labels[-2].lower() == "example" else 1
        return reshaped(local + "a" * (attempt // 8), draw) + "@" + ".".join([*(reshaped(x, draw) for x in labels[:-fixed]), *labels[-fixed:]])
    if base == "ip":
        return ".".join(str((x := min(3, len(part) + attempt // 8) + len(longer), 1 + draw.below(9) if x == 1 else 10 + draw.below(90) if x == 2 else 100 + draw.below(155) if x == 3 else f"{100 + draw.below(155)}{longer}")[1]) for part in entity.split("."))
    if base == "secret":
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in entity)
        if not hexadecimal:
            return reshaped(entity + longer, draw)
        upper = entity == entity.upper()
        drawn = "".join("0123456789abcdef"[draw.below(16)] for _ in entity + longer)
        return drawn.upper() if upper else drawn
    if base == "phone":
        # the country stays
        head = m.end() if (m := re.match(r"\+\d{1,3}(?=\D|$)", entity)) else 0
        return entity[:head] + reshaped(entity[head:] + longer, draw)
    if base == "number":
        drawn = reshaped(entity + longer, draw)
        old = [int(c) for c in entity if c.isdigit()]
        if len(old) >= 12 and not luhn(old):
            last = max(k for k, c in enumerate(drawn) if c.isdigit())
            new = [int(c) for c in drawn if c.isdigit()]
            drawn = drawn[:last] + str((new[-1] - luhn(new)) % 10) + drawn[last + 1 :]
        return drawn
    if base == "family":
        syllables = SYLLABLES[script(entity)].split()
        made = "".join(syllables[draw.below(len(syllables))] for _ in range(3 + attempt)).capitalize()
        return made.upper() if entity.isupper() else made
    if base == "given":
        pool = GIVEN[script(entity), sex if sex != "n" else "mf"[draw.below(2)]].split()
        # never the same name again; after eight draws two given names, then three
        pool = [x for x in pool if x.lower() != entity.split(" ")[0].lower()]
        made = "-".join(pool[draw.below(len(pool))] for _ in range(1 + attempt // 8))
        return made.upper() if entity.split(" ")[0].isupper() else made
    return reshaped(entity + longer, draw)


def surrogate(key: bytes, kind: str, entity: str, again: dict[bytes, tuple[int, str]] | None = None) -> str:
    """The surrogate of an entity. again: attempt and kind of parts, by their keyed hashes, that drew again or have another gender."""
    made = []
    for part_kind, text, form in parts(kind, entity):
        attempt, part_kind = (again or {}).get(named(key, form), (0, part_kind)) if again else (0, part_kind)
        made.append(drawn_part(key, part_kind, text, form, attempt))
    return " ".join([*made[1:], made[0]])


FOUND = "doc_id long, text_hash long, spans array<struct<start:int,end:int,kind:string>>, parts array<struct<name:binary,kind:string,sealed:binary>>"


def find(docs: DataFrame, key: bytes) -> DataFrame:
    """FOUND for each document (doc_id, text) with entities: their places and distinct parts."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    parts_type = pa.list_(pa.struct([("name", pa.binary()), ("kind", pa.string()), ("sealed", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, spans, held = [], [], [], []
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found := list(entities(text)):
                    distinct = {(k, t, f) for a, b, kind in found for k, t, f in parts(kind, text[a:b])}
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                    held.append([{"name": (n := named(key, f)), "kind": k, "sealed": sealed(key, n, t.encode())} for k, t, f in sorted(distinct)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(spans, spans_type), pa.array(held, parts_type)], names=["doc_id", "text_hash", "spans", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").rlike(HINT)).mapInArrow(run, FOUND)


def drawn(names: DataFrame, key: bytes) -> DataFrame:
    """names (name, kind, sealed, attempt) with alias: the keyed hash of the surrogate's canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, kind, shut, attempt in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = sealed(key, name, shut).decode()
                if kind.startswith("given"):
                    # apart from others in the same family; families are apart themselves
                    given, family = text.split(" ")
                    form = f"given:{given.lower()} {family.lower()}"
                    made.append(named(key, f"alias:{drawn_part(key, kind, text, form, attempt).lower()} {family.lower()}"))
                else:
                    form = f"family:{text.lower()}" if kind == "family" else parts(kind, text)[0][2]
                    other = drawn_part(key, kind, text, form, attempt)
                    made.append(named(key, f"family:{other.lower()}" if kind == "family" else parts(kind, other)[0][2]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "alias"])

    return names.select("name", "kind", "sealed", "attempt").mapInArrow(run, "name binary, kind string, sealed binary, attempt int, alias binary")


def redraws(found: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(name, attempt, kind) of the parts that don't keep their first draw or whose mentions differ in gender. Only colliding ones
    are drawn again in a round, against the aliases that the others hold."""
    rows = found.select(F.explode("parts").alias("x")).select("x.*")
    # the gender that most documents give, and of equally many f before m; n only if no mention tells
    sexes = [F.sum((F.substring_index("kind", "-", -1) == x).cast("long")).alias(x) for x in "mf"]
    sums = rows.groupBy("name").agg(F.min("kind").alias("least"), F.max("kind").alias("most"), F.min("sealed").alias("sealed"), *sexes)
    kind = F.when(~F.col("least").startswith("given"), F.col("least")).when(F.col("f") + F.col("m") == 0, "given-n").when(F.col("f") >= F.col("m"), "given-f").otherwise("given-m")
    names = scratch.save(sums.select("name", kind.alias("kind"), "sealed", (F.col("least") != F.col("most")).alias("mixed")), "names")
    settled, todo, out, used = names.select(F.col("name").alias("alias")), names.withColumn("attempt", F.lit(0)), None, [names]
    while True:
        now = scratch.save(drawn(todo, key), "drawn")
        kept_alias = now.groupBy("alias").agg(F.min("name").alias("name")).join(settled, "alias", "left_anti")
        kept = scratch.save(now.join(kept_alias, ["alias", "name"], "left_semi").select("name", "kind", "attempt", "alias"), "kept")
        again = scratch.save(now.join(kept.select("name"), "name", "left_anti").select("name", "kind", "sealed", (F.col("attempt") + 1).alias("attempt")), "again")
        moved = kept.where("attempt > 0") if out is not None else kept.join(names.where("mixed").select("name"), "name", "left_semi")
        out = moved.select("name", "attempt", "kind") if out is None else out.unionAll(moved.select("name", "attempt", "kind"))
        settled, used = settled.unionAll(kept.select("alias")), [*used, now, again]
        if not again.limit(1).count():
            break
        todo = again
    out = scratch.save(out, "redraws")
    scratch.drop(*used)
    return out


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """docs (doc_id, text and more) with every entity of text replaced, and n_entities (mentions) and kinds (sorted) beside it.

    key: secret bytes; another key gives other surrogates. Null texts stay null, texts without entities stay as they are.
    Repeated rows are replaced alike. Columns of docs called n_entities or kinds give way. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(find(docs, key), "found")
    moved = redraws(found, key, scratch)
    places = scratch.save(found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"), F.first(F.col("parts.name")).alias("names")), "places")
    scratch.drop(found)
    by_doc = places.select("doc_id", "text_hash", F.explode(F.array_distinct("names")).alias("name")).join(moved, "name").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("name", "attempt", "kind")).alias("again"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    places = places.alias("a").join(scratch.save(by_doc, "by-document").alias("b"), same, "left").select("a.doc_id", "a.text_hash", "a.spans", "b.again")
    rest = docs.drop("n_entities", "kinds")
    id_, hash_, spans, again, held = (free(x, rest) for x in ("found_id", "found_hash", "spans", "again", "made"))
    places = places.withColumnsRenamed({"doc_id": id_, "text_hash": hash_, "spans": spans, "again": again})
    joined = rest.join(places, rest["doc_id"].cast("long").eqNullSafe(places[id_]) & (F.xxhash64(rest["text"]) == places[hash_]), "left").drop(id_, hash_)

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places, agains in batches:
            out = [rewritten(t, p, {bytes(x["name"]): (x["attempt"], x["kind"]) for x in ([] if a is None else a)}, key) for t, p, a in zip(texts, places, agains, strict=True)]
            yield pd.DataFrame(out, columns=["text", "n_entities", "kinds"])

    # Spark doesn't keep rows from a function by a condition around it
    made = F.pandas_udf(run, "text string, n_entities int, kinds array<string>")(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans), F.col(again))
    with_made = joined.withColumn(held, made)
    return with_made.withColumn("text", F.coalesce(F.col(held)["text"], "text")).withColumn("n_entities", F.coalesce(F.col(held)["n_entities"], F.lit(0))).withColumn("kinds", F.coalesce(F.col(held)["kinds"], F.array().cast("array<string>"))).drop(held, again, spans)


def rewritten(text: str | None, places: list[dict] | None, again: dict[bytes, tuple[int, str]], key: bytes) -> tuple[str | None, int, list[str]]:
    if text is None:
        return None, 0, []
    out, at, kinds = [], 0, set()
    for x in places:
        start, end, kind = x["start"], x["end"], x["kind"]
        out += [text[at:start], surrogate(key, kind, text[start:end], again)]
        kinds.add(kind.split("-")[0])
        at = end
    return "".join([*out, text[at:]]), len(places), sorted(kinds)
