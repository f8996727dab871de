"""Relational operators over streams, as DataFrame compositions that the optimiser plans."""

from rivulet.operators.aggregate import aggregate, changelog, final_windows, latest_by_key, tumbling_aggregate
from rivulet.operators.join import hash_join, lookup_join, within_join
from rivulet.operators.scan import index_scan, key_lookup, reverse_tail, scan, top_n

__all__ = [
    "aggregate", "changelog", "final_windows", "hash_join", "index_scan", "key_lookup", "latest_by_key", "lookup_join", "reverse_tail", "scan", "top_n", "tumbling_aggregate", "within_join",
]
