"""Writers: delimited tables, spreadsheets, Markdown, HTML previews, versioned results."""
