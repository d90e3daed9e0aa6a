x545