"""Money as integer paise: parsing, formatting, rates. All functions take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fee bands in basis points by method, standard rates, tax on fees.
FEE_BANDS = {"upi": (0, 40)}
OTHER_BAND = (160, 240)
STANDARD_BPS = {"upi": 20, "card": 200, "netbanking": 180, "wallet": 220, "emi": 250}
GST_BPS = 1800
LARGEST = 2**53 - 1


#: White space in every script, a currency mark, a sign, and digits with grouping commas.
_BLANK = r"[\s\x{A0}\x{FEFF}]*"
_AMOUNT = rf"(?:INR|Rs\.?|₹)?{_BLANK}[-+]?{_BLANK}([\d,]*\.?[\d,]*)"
_SHAPE = rf"(?i)^{_BLANK}(?:\({_BLANK}{_AMOUNT}{_BLANK}\)|{_AMOUNT}){_BLANK}$"


def parse_paise(raw: Column) -> Column:
    """Rupee text -> paise, null where it is not an amount.

    Takes accounting parentheses, a currency mark before the sign, a sign, and grouping commas;
    parentheses and minus cancel. At most two decimals; at least one digit; no rounding ever.
    """
    inside = F.regexp_extract(raw, _SHAPE, 1)
    number = F.replace(F.concat(inside, F.regexp_extract(raw, _SHAPE, 2)), F.lit(","), F.lit(""))
    paise = F.when(number.rlike(r"^(?=.*\d)\d*\.?\d{0,2}$"), (number.try_cast("decimal(25,2)") * 100).try_cast("bigint"))
    negative = (inside != "") != raw.rlike(r"^\D*-")
    return F.when(paise <= LARGEST, F.when(negative, -paise).otherwise(paise))


def rupee_string(paise: Column) -> Column:
    """Paise -> plain decimal text."""
    frac = F.abs(paise) % 100
    whole = ((F.abs(paise) - frac) / 100).cast("bigint").cast("string")
    return F.concat(F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), F.lpad(frac.cast("string"), 2, "0"))


def format_paise(paise: Column) -> Column:
    """Decimal text with lakh grouping: the last three digits, then pairs."""
    frac = F.abs(paise) % 100
    whole = ((F.abs(paise) - frac) / 100).cast("bigint").cast("string")
    n = F.length(whole)
    head = F.substring(whole, F.lit(1), F.greatest(n - 3, F.lit(0)))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    body = F.when(n > 3, F.concat(grouped, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.concat(F.when(paise < 0, F.lit("-")).otherwise(F.lit("")), body, F.lit("."), F.lpad(frac.cast("string"), 2, "0"))


def format_inr(paise: Column) -> Column:
    return F.concat(F.when(paise < 0, F.lit("-₹")).otherwise(F.lit("₹")), format_paise(F.abs(paise)))


def format_variance(paise: Column) -> Column:
    """Always signed, with the true minus sign; zero has none."""
    sign = F.when(paise > 0, F.lit("+")).when(paise < 0, F.lit("−")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("₹"), format_paise(F.abs(paise)))


def rate_bps(paise: Column, bps: Column | int) -> Column:
    """Share of an amount (0 or more) in basis points, half up."""
    x = paise * (F.lit(bps) if isinstance(bps, int) else bps) + F.lit(5000)
    return ((x - x % 10000) / 10000).cast("bigint")


def fee_parts(amount: Column, bps: Column) -> tuple[Column, Column, Column]:
    """Fee, tax on it, and what remains."""
    fee = rate_bps(amount, bps)
    tax = rate_bps(fee, GST_BPS)
    return fee, tax, amount - fee - tax


def fee_bps(fee: Column, amount: Column) -> Column:
    """Fee as whole basis points of the amount, half up; null at amount zero."""
    return F.when(amount != 0, F.floor(fee / amount * 10000 + 0.5))


def fee_in_band(fee: Column, amount: Column, method: Column) -> Column:
    low, high = F.lit(OTHER_BAND[0]), F.lit(OTHER_BAND[1])
    for m, (a, b) in FEE_BANDS.items():
        low, high = F.when(method == m, F.lit(a)).otherwise(low), F.when(method == m, F.lit(b)).otherwise(high)
    return (amount == 0) | fee_bps(fee, amount).between(low, high)


def ratio4(part: Column, whole: Column) -> Column:
    """Part of whole to four decimals, half up; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part / whole * 10000 + 0.5) / 10000)


def milli(value: Column) -> Column:
    """A confidence in thousandths, clamped to 0..1, as a double."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), value)) / F.lit(1000.0)
