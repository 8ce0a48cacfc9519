"""Registered queries over the bundled tables, each with its oracle where SQL can express it."""

from replyloom.registry import answers, graph, metrics, posts, sources, text, vectors

ENTRIES = {
    **posts.ENTRIES, **graph.ENTRIES, **text.ENTRIES, **metrics.ENTRIES, **vectors.ENTRIES,
    **sources.ENTRIES, **answers.ENTRIES,
}
