from flowlens.functions.exprs import half_up_ratio, rnd, rnd_sql, safe_div, stable_hash, stable_hash_sql

__all__ = ["half_up_ratio", "rnd", "rnd_sql", "safe_div", "stable_hash", "stable_hash_sql"]
