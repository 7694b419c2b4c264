"""Column expressions."""

from .keys import digest_word, key_to_token, keyed_digest, keyed_int, keyed_unit, random_key, share_mask
from .scores import (
    activation,
    approx_sigmoid,
    grad_hess_approx,
    grad_hess_logistic,
    grad_hess_mse,
    grad_hess_softmax,
    pick_objective,
    sigmoid,
    sign_label,
    softmax,
    to_int_labels,
)

__all__ = [n for n in dir() if not n.startswith("_")]
