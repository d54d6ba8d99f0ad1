"""What is done to bytes: filters, codecs, frames, and typed columns in and out of them."""
