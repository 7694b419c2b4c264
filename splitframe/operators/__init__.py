"""Relational operators."""

from .align import (
    blind,
    equi_join,
    hash_to_group,
    hot_keys,
    key_intersection,
    number_copies,
    psi_blinded_join,
    psi_cardinality,
    psi_join,
    psi_public_columns,
    psi_row_index,
    salted_token,
)
from .binning import (
    Edges,
    bin_before_join,
    bin_compact_edges,
    bin_edge_join,
    bin_label,
    bin_members,
    exact_quantiles,
    quantile_edges,
)
from .position import concat_by_position, global_position, position_rows
from .prep import (
    batch_assign,
    find_label_party,
    hashed_train_test_split,
    label_classes,
    merge_headers,
    one_hot_label,
    ordered_train_test_split,
    party_apply,
    party_sample,
    project_label_columns,
    random_reorder,
    recode_label_01,
    recode_label_pm1,
    sample_batch,
    split_x_y,
    stack_rows,
    vertical_split,
)
from .shares import psi_shares, share_group_sum, share_reconstruct, share_split
from .splits import (
    best_split,
    gh_histogram,
    gh_total,
    leaf_weight,
    split_gain,
    split_or_leaf,
    split_prefix_sums,
    tree_route,
)

__all__ = [n for n in dir() if not n.startswith("_")]
