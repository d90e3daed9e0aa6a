x212