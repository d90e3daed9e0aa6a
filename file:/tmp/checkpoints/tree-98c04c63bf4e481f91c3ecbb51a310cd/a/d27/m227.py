x227