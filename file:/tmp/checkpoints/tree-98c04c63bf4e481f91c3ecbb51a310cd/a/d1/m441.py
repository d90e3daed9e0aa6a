x441