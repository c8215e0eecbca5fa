"""Normalizers and validity checks for addresses, chains, timestamps and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chain names and their aliases, and the address patterns.
EVM_CHAINS = ("ethereum", "bsc", "polygon", "avalanche", "arbitrum", "base")
CHAIN_ALIASES = {
    "eth": "ethereum", "ether": "ethereum", "bsc": "bsc", "bnb": "bsc", "binance": "bsc", "sol": "solana",
    "matic": "polygon", "poly": "polygon", "avax": "avalanche", "arb": "arbitrum",
}
REQUEST_CHAINS = ("ethereum", "bsc", "polygon", "solana", "arbitrum", "optimism", "avalanche")
REQUEST_HORIZONS = ("1h", "4h", "24h", "7d", "30d", "90d")
EVM_ADDRESS = "^0x[a-fA-F0-9]{40}$"
SOLANA_ADDRESS = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"

# Program ids, instruction prefixes and log words of known venues.
DEX_PROGRAMS = {
    "JUP4Fb2cqiRUcaTHdrPC8h2gNsA2ETXiPDD33WcGuJB": "jupiter",
    "675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8": "raydium",
    "9W959DqEETiGZocYWCQPaJ6sBmUzgfxXfqGeTEdp3aQP": "orca",
    "9xQeWvG816bUx9EPjHmaT23yvVM2ZWbrrpZb9PusVFin": "serum",
}
DEX_PREFIXES = {"e445a52e51cb9a1d": "jupiter", "09": "raydium", "f8c69e91e17587c8": "orca"}
DEX_WORDS = ("jupiter", "raydium", "orca", "serum")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_chain(c: Column) -> Column:
    low = F.trim(F.lower(c))
    return F.coalesce(_lookup(low, CHAIN_ALIASES), low)


def normalize_address(address: Column, chain: Column) -> Column:
    a = F.trim(address)
    evm = F.lower(F.when(a.startswith("0x"), a).otherwise(F.concat(F.lit("0x"), a)))
    return F.when(chain.isin(*EVM_CHAINS), evm).when(chain == "solana", a).otherwise(F.lower(a))


def normalize_timestamp(text: Column) -> Column:
    """ISO (with Z or offset), ``yyyy-MM-dd[ HH:mm:ss]`` and ``MM/dd/yyyy``; null where none fits.

    Each reader is guarded by the shape it is meant for, so a lenient parser
    cannot accept another form.
    """
    t = F.trim(text)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    us = t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.when(iso, t.try_cast("timestamp")).when(us, F.try_to_timestamp(t, F.lit("M/d/yyyy")))


def normalize_epoch(value: Column) -> Column:
    """Epoch seconds, or milliseconds when above 1e10."""
    v = value.cast("double")
    return F.timestamp_micros(F.round(F.when(v > 1.0e10, v / 1000.0).otherwise(v) * 1.0e6).cast("bigint"))


def clean_numeric(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(value, "[,$]", "")).try_cast("double"), F.lit(default))


def is_valid_token(address: Column, chain: Column) -> Column:
    given = (F.coalesce(address, F.lit("")) != "") & (F.coalesce(chain, F.lit("")) != "")
    return given & F.when(chain.isin("ethereum", "bsc", "polygon"), address.rlike(EVM_ADDRESS)).otherwise(True)


def is_valid_wallet(address: Column, chain: Column) -> Column:
    c = normalize_chain(chain)
    return F.when(c.isin(*EVM_CHAINS), address.rlike(EVM_ADDRESS)).when(c == "solana", address.rlike(SOLANA_ADDRESS)).otherwise(False)


def request_quality(address: Column, chain: Column, horizon: Column) -> dict[str, Column]:
    evm, n = chain.isin("ethereum", "bsc", "polygon"), F.length(address)
    shape = F.when(evm, address.startswith("0x") & (n == 42)).when(chain == "solana", (n >= 32) & (n <= 44)).otherwise(True)
    return {
        "address_ok": (F.coalesce(address, F.lit("")) != "") & shape,
        "chain_ok": F.lower(chain).isin(*REQUEST_CHAINS),
        "horizon_ok": horizon.isin(*REQUEST_HORIZONS),
    }


def identify_dex(program: Column, data: Column, logs: Column) -> Column:
    """Program id, then instruction prefix, then the first log line that names a venue."""
    by_prefix = None
    for prefix, name in DEX_PREFIXES.items():
        by_prefix = F.when(data.startswith(prefix), name) if by_prefix is None else by_prefix.when(data.startswith(prefix), name)

    def named(line: Column) -> Column:
        low, out = F.lower(line), None
        for word in DEX_WORDS:
            out = F.when(low.contains(word), word) if out is None else out.when(low.contains(word), word)
        return out

    by_log = F.get(F.array_compact(F.transform(F.coalesce(logs, F.array().cast("array<string>")), named)), F.lit(0))
    return F.coalesce(_lookup(program, DEX_PROGRAMS), by_prefix, by_log, F.lit("unknown_dex"))


def duration_seconds(c: Column) -> Column:
    """``Nh`` or ``Nd`` in seconds; anything else is null."""
    n = F.regexp_extract(c, r"^(\d+)[hd]$", 1).try_cast("bigint")
    return n * F.when(c.endswith("h"), 3600).when(c.endswith("d"), 86400)


def parse_duration(text: str) -> int:
    """The same for a parameter; anything else is an error."""
    if len(text) < 2 or text[-1] not in "hd" or not text[:-1].isdigit():
        raise ValueError(f"unknown duration: {text}")
    return int(text[:-1]) * (3600 if text[-1] == "h" else 86400)


def period_bounds(period: str, as_of: Column) -> tuple[Column, Column]:
    """Start and end of a report period; all-time starts at 2020-01-01."""
    if period == "all-time":
        return F.lit("2020-01-01").cast("timestamp"), as_of
    if period not in ("1d", "7d", "30d"):
        raise ValueError(f"unknown period: {period}")
    return as_of - F.expr(f"INTERVAL {period[:-1]} DAYS"), as_of


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8))
