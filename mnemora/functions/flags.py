"""Quality flags of one record, kept as bits so that merging is one map-side ``bit_or``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


class Flags:
    def __init__(self, *names: str):
        self.names = sorted(names)

    def mask(self, **conditions: Column) -> Column:
        """Bits of the flags whose condition holds; a null condition does not hold."""
        total = F.lit(0).cast("bigint")
        for name, condition in conditions.items():
            bit = 1 << self.names.index(name)
            total = total.bitwiseOR(
                F.when(condition, F.lit(bit)).otherwise(F.lit(0)).cast("bigint")
            )
        return total

    def read(self, mask: Column) -> Column:
        """The flag names, sorted."""
        return F.array_compact(
            F.array(*[
                F.when(mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(name))
                for i, name in enumerate(self.names)
            ])
        )
