from lidarlake.functions.rounding import round_half_away
from lidarlake.functions.times import epoch_seconds, to_timestamp
from lidarlake.functions.zorder import morton

__all__ = ["epoch_seconds", "morton", "round_half_away", "to_timestamp"]
