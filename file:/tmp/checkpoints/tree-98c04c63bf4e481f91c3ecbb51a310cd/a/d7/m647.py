x647