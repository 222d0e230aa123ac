"""Claim and citation checking over corpora of papers, expressed as Spark DataFrame jobs."""

from evidence.session import build_session, configure, scratch_dir

__all__ = ["build_session", "configure", "scratch_dir"]
