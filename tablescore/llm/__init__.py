"""Training-data operators: each works on whole tables of documents, pages or conversations.

Nothing outside this folder imports it; the folder can be deleted and the table-scoring engine
keeps working.
"""
