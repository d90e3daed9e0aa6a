x884