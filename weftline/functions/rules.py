"""Value rules: which rule fills which field, decided once on the driver, and the value as a Column.

Rules are tried by priority, then in their registered order; the first that claims a field has it.
Columns come in tiers of ascending priority, so a rule can read what lower tiers made. A
sibling can be null in a row: then that row falls back to the independent form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import UnsupportedField
from weftline.functions.rng import pick, uniform
from weftline.model import Entity, Field, Options

# The instant that generated times count back from, 2026-01-01 UTC in microseconds, and the spans in days.
NOW_MICROS = 1_767_225_600_000_000
DAY_MICROS = 86_400_000_000
CREATED_DAYS, UPDATED_DAYS = 730, 90
# Fixed value: share of rows that a soft-delete field leaves visible.
VISIBLE = 0.9
# Check-digit weights of the two document numbers.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))

FIRST_NAMES = ("Alice", "Ben", "Clara", "David", "Emma", "Frank", "Grace", "Henry", "Ivy", "Jack", "Kate", "Liam", "Mia", "Noah", "Olive", "Peter", "Quinn", "Rosa", "Sam", "Tess")
LAST_NAMES = ("Adams", "Baker", "Clark", "Dixon", "Evans", "Fisher", "Grant", "Hayes", "Irwin", "Jones", "King", "Lewis", "Moore", "Nolan", "Owens", "Price", "Reed", "Stone", "Turner", "Young")
DOMAINS = ("example.com", "example.net", "example.org", "mail.example.com", "post.example.org")
CITIES = ("Ashford", "Brookside", "Clearwater", "Dunmore", "Eastwood", "Fairview", "Glenhaven", "Hillcrest", "Lakeside", "Riverton")
STREETS = ("Oak Street", "Mill Lane", "Station Road", "High Street", "Park Avenue", "Church Row", "Maple Drive", "King Street", "Bridge Road", "Elm Court")
WORDS = ("amber", "basin", "cedar", "delta", "ember", "fable", "grove", "haven", "inlet", "jolly", "kiosk", "lumen", "maple", "north", "ocean", "pearl")

# Pools of our own for the pt_BR locale: everyday given and family names, cities, streets and area codes.
PT_FIRST_NAMES = (
    "Alberto", "Antonia", "Arthur", "Benedito", "Caio", "Cecilia", "Clarice", "Davi", "Elisa", "Enzo", "Heitor", "Helena", "Henrique", "Iara", "Isabela",
    "Joaquim", "Jorge", "Laura", "Livia", "Luiza", "Manuela", "Murilo", "Otavio", "Raquel", "Regina", "Samuel", "Sofia", "Tereza", "Vicente", "Yasmin",
)
PT_LAST_NAMES = (
    "Aguiar", "Amaral", "Azevedo", "Barros", "Batista", "Borges", "Campos", "Coelho", "Cunha", "Duarte", "Farias", "Freitas", "Guimaraes", "Macedo",
    "Machado", "Medeiros", "Mendes", "Monteiro", "Moura", "Pinto", "Pires", "Queiroz", "Ramos", "Reis", "Sales", "Siqueira", "Tavares", "Torres", "Vasconcelos", "Xavier",
)
PT_CITIES = ("Aracaju", "Blumenau", "Boa Vista", "Caxias do Sul", "Cuiaba", "Juiz de Fora", "Londrina", "Macapa", "Niteroi", "Olinda", "Palmas", "Pelotas", "Porto Velho", "Santos", "Uberlandia", "Vitoria")
PT_STREET_TYPES = ("Rua", "Avenida", "Praca", "Estrada", "Largo")
PT_STREETS = ("da Aurora", "da Matriz", "das Acacias", "das Palmeiras", "do Comercio", "do Mercado", "do Porto", "dos Ipes", "dos Pinheiros", "da Estacao", "Bela Vista", "Boa Esperanca", "Nova", "Santa Clara", "Vista Alegre")
PT_AREAS = tuple(str(n) for n in (12, 13, 16, 19, 22, 24, 27, 32, 34, 43, 45, 49, 53, 54, 63, 65, 67, 73, 79, 82, 83, 84, 86, 92, 95, 98))

#: A draw of the current field: ``draw(salt)`` is uniform and differs by salt.
Draw = Callable[..., Column]


@dataclass(frozen=True)
class Siblings:
    """Fields of the row that lower tiers made, by Pascal name."""

    made: dict[str, Field]

    def find(self, fits: Callable[[Field], bool], *suffixes: str) -> Column | None:
        """The first sibling of that kind: by whole name, else by suffix, names in order."""
        names = sorted(self.made)
        for test in (str.__eq__, str.endswith):
            for name in names:
                field = self.made[name]
                if fits(field) and any(test(name.lower(), s.lower()) for s in suffixes):
                    return F.col(f"`{field.name}`")
        return None


@dataclass(frozen=True)
class Rule:
    """One way to make values. ``infer(field, draw, siblings)`` returns the Column."""

    name: str
    priority: int
    claims: Callable[[Field], bool]
    infer: Callable[[Field, Draw, Siblings], Column]


def pascal(name: str) -> str:
    """Snake or camel case to Pascal case."""
    return "".join(part[:1].upper() + part[1:] for part in name.split("_"))


def ends(field: Field, *suffixes: str) -> bool:
    return pascal(field.name).lower().endswith(tuple(s.lower() for s in suffixes))


def _is(kind: str, *suffixes: str, but: tuple[str, ...] = ()) -> Callable[[Field], bool]:
    return lambda f: getattr(f, kind) and (not suffixes or ends(f, *suffixes)) and not (but and ends(f, *but))


def digits_of(draw: Draw, n: int) -> list[Column]:
    return [F.floor(draw(f"digit{i}") * 10).cast("int") for i in range(n)]


def check_digit(digits: list[Column], weights: tuple[int, ...]) -> Column:
    rest = sum((d * w for d, w in zip(digits, weights, strict=True)), F.lit(0)) % 11
    return F.when(rest < 2, F.lit(0)).otherwise(F.lit(11) - rest)


def document_number(draw: Draw, n: int, weights: tuple[tuple[int, ...], tuple[int, ...]]) -> Column:
    """Digits and their two check digits. An array is bound once and read often, so no draw is made twice."""
    base = F.array(*digits_of(draw, n))

    def finish(a: Column) -> Column:
        own = [a[i] for i in range(n)]
        first = check_digit(own, weights[0])
        return F.concat(*(x.cast("string") for x in [*own, first, check_digit([*own, first], weights[1])]))

    return F.transform(F.array(base), finish)[0]


def _document(field: Field, draw: Draw, _: Siblings) -> Column:
    return document_number(draw, 12, CNPJ_WEIGHTS) if ends(field, "Cnpj") else document_number(draw, 9, CPF_WEIGHTS)


def _named(first: tuple[str, ...], last: tuple[str, ...]) -> Callable:
    return lambda field, draw, _: pick(last if ends(field, "LastName") else first, draw())


def _email(field: Field, draw: Draw, siblings: Siblings) -> Column:
    alone = F.concat(F.lower(pick(WORDS, draw("word"))), F.floor(draw("number") * 10000).cast("string"), F.lit("@"), pick(DOMAINS, draw("domain")))
    first, last = (siblings.find(lambda f: f.is_string, s) for s in ("FirstName", "LastName"))
    if first is None or last is None:
        return alone
    joined = F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), pick(DOMAINS, draw("domain")))
    return F.when(first.isNotNull() & last.isNotNull(), joined).otherwise(alone)


def _phone(field: Field, draw: Draw, _: Siblings) -> Column:
    return F.lpad(F.floor(draw() * 1e10).cast("string"), 10, "0")


def _pt_phone(field: Field, draw: Draw, _: Siblings) -> Column:
    part = lambda salt: F.lpad(F.floor(draw(salt) * 10000).cast("string"), 4, "0")
    return F.concat(F.lit("+55 ("), pick(PT_AREAS, draw("area")), F.lit(") 9"), part("front"), F.lit("-"), part("back"))


def _url(field: Field, draw: Draw, _: Siblings) -> Column:
    return F.concat(F.lit("https://www."), pick(WORDS, draw("host")), F.lit(".com/"), pick(WORDS, draw("path")))


def _address(field: Field, draw: Draw, _: Siblings) -> Column:
    return pick(CITIES if ends(field, "City") else STREETS, draw())


def _pt_address(field: Field, draw: Draw, _: Siblings) -> Column:
    if ends(field, "City"):
        return pick(PT_CITIES, draw())
    return F.concat_ws(" ", pick(PT_STREET_TYPES, draw("kind")), pick(PT_STREETS, draw("name")))


def before_now(u: Column) -> Column:
    """An instant of the two years before the fixed present."""
    return F.timestamp_micros(F.lit(NOW_MICROS) - F.floor(u * float(CREATED_DAYS * DAY_MICROS)).cast("long"))


def _created(field: Field, draw: Draw, _: Siblings) -> Column:
    return before_now(draw())


def _updated(field: Field, draw: Draw, siblings: Siblings) -> Column:
    created = siblings.find(lambda f: f.is_time, "CreatedAt")
    if created is None:
        return before_now(draw())
    later = F.timestamp_micros(F.unix_micros(created.cast("timestamp")) + F.floor(draw("later") * float(UPDATED_DAYS * DAY_MICROS)).cast("long"))
    return F.coalesce(later, before_now(draw()))


def _price(field: Field, draw: Draw, _: Siblings) -> Column:
    return F.round(1 + draw() * 998.99, 2)


def _quantity(field: Field, draw: Draw, _: Siblings) -> Column:
    return (1 + F.floor(draw() * 20)).cast("long")


def _total(field: Field, draw: Draw, siblings: Siblings) -> Column:
    price = siblings.find(lambda f: f.is_float, "Price")
    quantity = siblings.find(lambda f: f.is_integer, "Quantity", "Qty")
    if price is None or quantity is None:
        return _price(field, draw, siblings)
    return F.coalesce(F.round(price * quantity * 100) / 100, _price(field, draw, siblings))


def _soft_delete(field: Field, draw: Draw, siblings: Siblings) -> Column:
    base = [s.cast("timestamp") for n in ("UpdatedAt", "CreatedAt") if (s := siblings.find(lambda f: f.is_time, n)) is not None]
    start = F.unix_micros(F.coalesce(*base)) if base else F.lit(None).cast("long")
    span = F.lit(NOW_MICROS) - start
    between = F.when(span <= 0, start).otherwise(start + F.floor(draw("when") * span).cast("long"))
    return F.when(draw("visible") >= VISIBLE, F.coalesce(F.timestamp_micros(between), before_now(draw("when"))))


def _text(field: Field, draw: Draw, _: Siblings) -> Column:
    return F.concat_ws(" ", *(pick(WORDS, draw(f"word{i}")) for i in range(3)))


def _number(field: Field, draw: Draw, _: Siblings) -> Column:
    return F.floor(draw() * 1001).cast("long") if field.is_integer else draw() * 1000


DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("document", 0, _is("is_string", "Cpf", "Cnpj"), _document),
    Rule("name", 0, _is("is_string", "FirstName", "LastName"), _named(FIRST_NAMES, LAST_NAMES)),
    Rule("email", 1, _is("is_string", "Email", "EmailAddress"), _email),
    Rule("phone", 0, _is("is_string", "Phone", "PhoneNumber"), _phone),
    Rule("url", 0, _is("is_string", "URL", "URI", "Website"), _url),
    Rule("address", 0, _is("is_string", "Street", "StreetName", "Address", "City", but=("EmailAddress",)), _address),
    Rule("created", 0, _is("is_time", "CreatedAt"), _created),
    Rule("updated", 1, _is("is_time", "UpdatedAt"), _updated),
    Rule("price", 0, _is("is_float", "Price", "Amount", "Cost"), _price),
    Rule("quantity", 0, _is("is_integer", "Quantity", "Qty"), _quantity),
    Rule("total", 1, _is("is_float", "Total", "Subtotal"), _total),
    Rule("soft delete", 2, lambda f: f.soft_delete, _soft_delete),
    Rule("text", 10, _is("is_string"), _text),
    Rule("number", 10, lambda f: f.is_integer or f.is_float, _number),
    Rule("bool", 10, _is("is_bool"), lambda field, draw, _: draw() < 0.5),
    Rule("time", 10, _is("is_time"), _created),
)

LOCALES: dict[str, tuple[Rule, ...]] = {
    "pt_BR": (
        Rule("pt name", -1, _is("is_string", "FirstName", "LastName"), _named(PT_FIRST_NAMES, PT_LAST_NAMES)),
        Rule("pt address", -1, _is("is_string", "Street", "StreetName", "Address", "City", but=("EmailAddress",)), _pt_address),
        Rule("pt phone", -1, _is("is_string", "Phone", "PhoneNumber"), _pt_phone),
    )
}


def rules_for(locale: str = "", extra: tuple[Rule, ...] = ()) -> list[Rule]:
    """All rules, ``extra`` ones first within their priority. An unknown locale adds none."""
    return sorted((*extra, *LOCALES.get(locale, ()), *DEFAULT_RULES), key=lambda r: r.priority)


def assign(entity: Entity, rules: list[Rule]) -> list[tuple[Field, Rule]]:
    """Each field that generation fills with its rule, by the rules' order."""
    keys = entity.reference_fields
    wanted = [f for f in entity.fields if f.name not in keys and not (f.primary_key and f.auto_increment)]
    out = [(f, next((r for r in rules if r.claims(f)), None)) for f in wanted]
    for field, rule in out:
        if rule is None:
            raise UnsupportedField(f"no rule for field {entity.name}.{field.name} of type {field.type.simpleString()}")
    return sorted(out, key=lambda x: rules.index(x[1]))


def generate(rows: DataFrame, entity: Entity, options: Options = Options(), row_index: str = "row_idx", rules: list[Rule] | None = None) -> DataFrame:
    """Add the entity's generated columns to rows that carry their index."""
    rules = rules_for(options.locale) if rules is None else rules
    made: dict[str, Field] = {}
    columns: dict[str, Column] = {}
    tier = None
    for field, rule in assign(entity, rules):
        if rule.priority != tier:
            # A finished tier becomes columns that this one can read.
            rows = rows.withColumns(columns) if columns else rows
            made |= {pascal(c): entity.field(c) for c in columns}
            columns, tier = {}, rule.priority

        def draw(*salts: str, name: str = field.name) -> Column:
            return uniform(options.seed, entity.name, F.col(row_index), name, *salts)

        value = rule.infer(field, draw, Siblings(dict(made)))
        if field.is_string and field.size > 0:
            value = F.substring(value, 1, field.size)
        value = value.cast(field.type)
        if options.nil_rate > 0 and field.nullable and not field.soft_delete:
            value = F.when(draw("NilRate") >= options.nil_rate, value)
        columns[field.name] = value
    return rows.withColumns(columns) if columns else rows
