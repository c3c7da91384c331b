"""Where rows come from: tables, landed feed responses, page links and subscription lists."""
