"""Detectors: each turns days into scores; flagging is a later, cheap cut on the score."""
