"""Format grammars of value types as Column expressions: every value made passes its type's check.

A grammar is a list of pieces. The bytes of one digest of (seed, type, value) feed them from left to right, so the same
input gives the same value on every executor, and no generator state travels.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: how many bytes a piece takes, and its text from a function that gives the byte at a place
Piece = tuple[int, Callable[[Callable[[int | Column], Column]], Column]]

# --- fixed values -----------------------------------------------------------------------------------
DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
VIN_LETTERS = "0123456789ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_VALUES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9, "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9}
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
FIRST = ["Ada", "Bruno", "Clara", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Irene", "Jonas", "Katya", "Liam", "Mara", "Nadia", "Oscar", "Petra"]
LAST = ["Abbott", "Bergman", "Castro", "Dupont", "Eriksen", "Fischer", "Gallo", "Hansen", "Ivanov", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Perez"]
CITY = ["Ashford", "Brookton", "Carlow", "Denby", "Elmsworth", "Fairview", "Glenwood", "Harlow", "Ironbridge", "Kingsley", "Lakeside", "Millbrook", "Norwood", "Oakham", "Pinehurst", "Redfield"]
STATE = ["Alabama", "Alaska", "Arizona", "Colorado", "Florida", "Georgia", "Idaho", "Kansas", "Maine", "Nevada", "Ohio", "Oregon", "Texas", "Utah", "Vermont", "Wyoming"]
WORD = ["amber", "basil", "cedar", "delta", "ember", "fjord", "grove", "harbor", "island", "juniper", "kelp", "lotus", "maple", "north", "opal", "prairie"]
FIELD = ["Finance", "Legal", "Design", "Research", "Logistics", "Security", "Sales", "Support"]
ROLE = ["Manager", "Engineer", "Analyst", "Director", "Officer", "Planner", "Clerk", "Advisor"]
CURRENCY_CODE = ["USD", "EUR", "GBP", "JPY", "CHF", "SEK", "CAD", "AUD"]
CURRENCY_NAME = ["US Dollar", "Euro", "Pound Sterling", "Yen", "Swiss Franc", "Swedish Krona", "Canadian Dollar", "Australian Dollar"]
CURRENCY_SYMBOL = ["$", "€", "£", "¥", "kr", "Fr", "zł", "₹"]
# ----------------------------------------------------------------------------------------------------


# --- check digits -----------------------------------------------------------------------------------
def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a text of digits, every second from the right doubled; the last digit counts once."""
    weighed = F.transform(_letters(F.reverse(digits)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(weighed, F.lit(0), lambda s, x: s + F.floor(x / 10).cast("int") + x % 10)


def with_luhn(digits: Column) -> Column:
    """digits and the digit that makes the whole pass."""
    return F.concat(digits, F.pmod(-luhn_sum(F.concat(digits, F.lit("0"))), F.lit(10)).cast("string"))


def mod97(text: Column) -> Column:
    """The number that digits and letters (A = 10 to Z = 35) spell, modulo 97, whatever their count."""
    value = lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1
    return F.aggregate(_letters(F.upper(text)), F.lit(0), lambda s, c: F.when(value(c) > 9, s * 100 + value(c)).otherwise(s * 10 + value(c)) % 97)


def iban(country: str, account: Column) -> Column:
    check = 98 - mod97(F.concat(account, F.lit(f"{country}00")))
    return F.concat(F.lit(country), F.lpad(check.cast("string"), 2, "0"), account)


def vin_check(vin: Column) -> Column:
    """The check character of 17; that at its own place has no weight."""
    values = F.create_map(*[x for c in VIN_LETTERS for x in (F.lit(c), F.lit(VIN_VALUES.get(c, 0) if c.isalpha() else int(c)))])
    weights = F.array(*map(F.lit, VIN_WEIGHTS))
    rest = F.aggregate(F.transform(_letters(vin), lambda c, i: values[c] * F.get(weights, i)), F.lit(0), lambda s, x: s + x) % 11
    return F.when(rest == 10, "X").otherwise(rest.cast("string"))


# --- pieces -----------------------------------------------------------------------------------------
def text(value: str) -> Piece:
    return 0, lambda byte: F.lit(value)


def chars(alphabet: str, n: int) -> Piece:
    one = lambda byte: lambda i: F.substring(F.lit(alphabet), byte(i) % len(alphabet) + 1, F.lit(1))
    return n, lambda byte: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one(byte)), "")


def pick(options: Sequence[str]) -> Piece:
    return 1, lambda byte: F.element_at(F.array(*map(F.lit, options)), byte(0) % len(options) + 1)


def number(low: int, high: int, width: int = 0) -> Piece:
    """A number from low to high, filled with zeros to a width."""

    def make(byte):
        n = (low + (byte(0) * 65536 + byte(1) * 256 + byte(2)) % (high - low + 1)).cast("string")
        return F.lpad(n, width, "0") if width else n

    return 3, make


def seq(*pieces: Piece, finish: Callable[[Column], Column] | None = None) -> Piece:
    """The pieces one after the other; finish adds check digits to the whole."""

    def make(byte):
        parts, used = [], 0
        for size, part in pieces:
            parts.append(part(lambda i, at=used: byte(at + i)))
            used += size
        whole = parts[0] if len(parts) == 1 else F.concat(*parts)
        return finish(whole) if finish else whole

    return sum(size for size, _ in pieces), make


def _date() -> Piece:
    return seq(number(1940, 2006), text("-"), number(1, 12, 2), text("-"), number(1, 28, 2))


def _vin(body: Column) -> Column:
    return F.concat(F.left(body, F.lit(8)), vin_check(body), F.substring(body, 10, 8))


def _ssn() -> Piece:
    area = number(1, 898, 3)  # 666 has no place: what comes from there on moves up by one
    moved = area[0], lambda byte: F.lpad(F.when(area[1](byte).cast("int") >= 666, area[1](byte).cast("int") + 1).otherwise(area[1](byte).cast("int")).cast("string"), 3, "0")
    return seq(moved, text("-"), number(1, 99, 2), text("-"), number(1, 9999, 4))


def _dotted(n: int, piece: Piece, mark: str) -> Piece:
    return seq(*[p for i in range(n) for p in ((piece,) if i == 0 else (text(mark), piece))])


_IP = _dotted(4, number(1, 254), ".")
_DIRECTION = ["North", "East", "South", "West"]
_NAME = seq(pick(FIRST), text(" "), pick(LAST))
GRAMMARS: dict[str, Piece] = {
    "EMAIL": seq(pick(WORD), text("."), pick([x.lower() for x in LAST]), number(1, 999), text("@"), pick(WORD), text(".example")),
    "PHONENUMBER": seq(text("("), number(200, 999), text(") 555-"), number(0, 9999, 4)),
    "SSN": _ssn(),
    "CREDITCARDNUMBER": seq(text("4"), chars(DIGITS, 14), finish=with_luhn),
    "CREDITCARDCVV": chars(DIGITS, 3),
    "IPV4": _IP,
    "IP": _IP,
    "IPV6": seq(text("2001:db8:"), _dotted(6, chars(HEX, 4), ":")),
    "MAC": _dotted(6, chars(HEX, 2), ":"),
    "DATE": _date(),
    "DOB": _date(),
    "TIME": seq(number(0, 23, 2), text(":"), number(0, 59, 2), text(":"), number(0, 59, 2)),
    "FIRSTNAME": pick(FIRST),
    "MIDDLENAME": pick(FIRST),
    "LASTNAME": pick(LAST),
    "FULLNAME": _NAME,
    "PREFIX": pick(["Mr.", "Ms.", "Mx.", "Dr."]),
    "USERNAME": seq(pick(WORD), text("_"), pick(WORD), number(1, 9999)),
    "PASSWORD": seq(chars(UPPER, 2), chars(LOWER, 5), chars("!#%*+?@_", 1), chars(DIGITS, 4)),
    "PIN": chars(DIGITS, 4),
    "URL": seq(text("https://"), pick(WORD), text("-"), pick(WORD), text(".example/"), chars(LOWER, 4)),
    "STREET": seq(pick(LAST), text(" "), pick(["Street", "Road", "Lane", "Avenue"])),
    "BUILDINGNUMBER": number(1, 9999),
    "SECONDARYADDRESS": seq(pick(["Apt. ", "Suite "]), number(1, 999)),
    "CITY": pick(CITY),
    "STATE": pick(STATE),
    "COUNTY": seq(pick(LAST), text(" County")),
    "ZIPCODE": chars(DIGITS, 5),
    "NEARBYGPSCOORDINATE": seq(text("["), number(-89, 89), text("."), chars(DIGITS, 4), text(", "), number(-179, 179), text("."), chars(DIGITS, 4), text("]")),
    "IBAN": seq(chars(DIGITS, 18), finish=lambda account: iban("DE", account)),
    "BIC": seq(chars(UPPER, 4), pick(["DE", "FR", "GB", "US"]), chars(UPPER, 2)),
    "ACCOUNTNUMBER": chars(DIGITS, 10),
    "ACCOUNTNAME": seq(pick([w.title() for w in WORD]), text(" Account")),
    "AMOUNT": seq(number(1, 9999), text("."), chars(DIGITS, 2)),
    "CURRENCYCODE": pick(CURRENCY_CODE),
    "CURRENCYNAME": pick(CURRENCY_NAME),
    "CURRENCYSYMBOL": pick(CURRENCY_SYMBOL),
    "COMPANYNAME": seq(pick(LAST), text(" "), pick(["Group", "Ltd", "Inc", "Partners"])),
    "JOBTITLE": seq(pick(FIELD), text(" "), pick(ROLE)),
    "JOBAREA": pick(FIELD),
    "JOBTYPE": pick(ROLE),
    "AGE": number(18, 90),
    "SEX": pick(["male", "female"]),
    "GENDER": pick(["Male", "Female", "Non-binary"]),
    "EYECOLOR": pick(["Blue", "Brown", "Green", "Hazel", "Gray"]),
    "HEIGHT": seq(number(150, 200), text(" cm")),
    "USERAGENT": seq(text("Mozilla/5.0 (X11; Linux x86_64) Browser/"), number(60, 140), text("."), number(0, 9)),
    "VEHICLEVIN": seq(chars(VIN_LETTERS, 17), finish=_vin),
    "VEHICLEVRM": seq(chars(UPPER, 2), chars(DIGITS, 2), text(" "), chars(UPPER, 3)),
    "PHONEIMEI": seq(text("35"), chars(DIGITS, 12), finish=with_luhn),
    "BITCOINADDRESS": seq(text("1"), chars(BASE58, 33)),
    "ETHEREUMADDRESS": seq(text("0x"), chars(HEX, 40)),
    "LITECOINADDRESS": seq(text("L"), chars(BASE58, 33)),
    "MASKEDNUMBER": chars(DIGITS, 12),
    "ORDINALDIRECTION": pick(_DIRECTION),
    "MEDICALRECORD": seq(text("MRN-"), chars(DIGITS, 8)),
}


# --- making and checking ----------------------------------------------------------------------------
def made(kind: str, key: Column) -> Column:
    """A value of a type's grammar from a key text: 64 bytes of two SHA-256 digests feed its pieces (a null key: null)."""
    digest = F.concat(*[F.sha2(F.concat(key, F.lit(f"\u0001{i}")).cast("binary"), 256) for i in range(2)])
    size, make = GRAMMARS[kind]
    assert size <= 64, kind
    byte = lambda d: lambda i: F.conv(F.substring(d, F.lit(i) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.array(digest), lambda d: make(byte(d)))[0]  # the digest is worked out once


def key_of(kind: Column, value: Column, seed: Column | int = 0) -> Column:
    number_ = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.concat_ws("\u0001", number_, kind, value)


def generated(kind: Column, value: Column, seed: Column | int = 0, kinds: Collection[str] | None = None) -> Column:
    """A value of the type's grammar that depends on (seed, type, value) alone; null for types without a grammar.

    kinds: the only types (in upper case) that occur, so that the driver does not plan the grammars of all others with each query.
    """
    key = key_of(kind, value, seed)
    cases = [(F.upper(kind) == k, made(k, key)) for k in GRAMMARS if kinds is None or k in kinds]
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("string")


def valid(kind: str, value: Column) -> Column:
    """Does a value pass its type's check digits, or the ranges of its numbers? True for types without either."""
    digits = F.regexp_replace(value, "[ -]", "")
    checks = {
        "CREDITCARDNUMBER": digits.rlike("^[0-9]{13,19}$") & (luhn_sum(digits) % 10 == 0),
        "PHONEIMEI": value.rlike("^[0-9]{15}$") & (luhn_sum(value) % 10 == 0),
        "IBAN": value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (mod97(F.concat(F.substring(value, 5, 30), F.left(value, F.lit(4)))) == 1),
        "VEHICLEVIN": value.rlike("^[0-9A-HJ-NPR-Z]{17}$") & (vin_check(value) == F.substring(value, 9, 1)),
        "SSN": value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
        "IPV4": value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$"),
    }
    return checks.get(kind, F.lit(True))
