"""Document layout and OCR text analytics as DataFrame and Column functions."""
