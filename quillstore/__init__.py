"""quillstore: a page, link, triple and vector store on Spark DataFrames."""
