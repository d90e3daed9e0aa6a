x603