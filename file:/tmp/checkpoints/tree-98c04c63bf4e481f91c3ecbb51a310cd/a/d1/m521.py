x521