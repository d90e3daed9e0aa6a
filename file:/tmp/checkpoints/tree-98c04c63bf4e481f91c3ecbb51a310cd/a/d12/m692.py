x692