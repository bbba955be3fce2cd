"""Streaming.

The survey finds no streaming work to rebuild: data always arrives by one-shot
reads, and there are no watermarks, time windows or stateful operators.  This
package therefore holds no operators of its own.  The row-wise ones (selection,
recoding, scalar functions, tokens, page titles and links, element selection)
keep no state and accept a streaming DataFrame as it is; ``tests/test_streaming.py``
runs them on one.
"""
