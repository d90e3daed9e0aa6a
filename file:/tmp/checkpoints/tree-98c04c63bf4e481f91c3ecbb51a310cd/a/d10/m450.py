x450