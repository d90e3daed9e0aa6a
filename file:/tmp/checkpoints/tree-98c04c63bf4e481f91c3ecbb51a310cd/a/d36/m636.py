x636