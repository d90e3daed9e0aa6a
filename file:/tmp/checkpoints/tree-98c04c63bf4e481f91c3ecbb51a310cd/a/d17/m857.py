x857