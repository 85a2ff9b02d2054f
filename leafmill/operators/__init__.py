"""Dataflow operators over lines, blocks, segments and attempts."""
