"""Constants of the scoring model."""

DIM = 14
SCALE = 10_000
K = 5
#: A transaction is approved if fewer neighbours than this are fraud.
DENY_AT = 3
#: Squared distance at which the approximate mode may stop, 1400 squared.
EARLY_STOP = 1_960_000
MINUTES_PER_DAY = 1_440

# What divides each amount before it is clamped to 0..1.
MAX_AMOUNT = 10_000.0
MAX_INSTALLMENTS = 12.0
AMOUNT_VS_AVG_RATIO = 10.0
MAX_MINUTES = 1_440.0
MAX_KM = 1_000.0
MAX_TX_COUNT_24H = 20.0
MAX_MERCHANT_AVG_AMOUNT = 10_000.0

# Risk of merchant category codes; other codes have the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_MCC_RISK = 0.5
MCC_SLOTS = 1_024

LEGIT, FRAUD = 0, 1
#: Leaves of the index hold about so many vectors; 8 to 1024.
LEAF_SIZE = 256
#: References are broadcast up to so many bytes, as a worker holds them; beyond, they are shuffled in blocks.
BROADCAST_BYTES = 256 << 20


def leaf_size(value: str | int | None) -> int:
    """A leaf size as configured: 8 to 1024, else the default."""
    try:
        n = int(value)
    except (TypeError, ValueError):
        return LEAF_SIZE
    return n if 8 <= n <= 1_024 else LEAF_SIZE
