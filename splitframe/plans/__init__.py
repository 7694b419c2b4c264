"""Training and scoring plans."""

from .boosting import GBTModel, TreeNode, gbt_fit, tree_fit
from .linear import LinearModel, evaluate, lr_fit, svm_fit
from .runs import RunOptions, RunResult, resume_linear, resume_trees, run_linear, run_trees
from .store import RunStore

__all__ = [n for n in dir() if not n.startswith("_")]
