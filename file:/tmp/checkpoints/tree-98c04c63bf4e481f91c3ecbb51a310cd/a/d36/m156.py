x156