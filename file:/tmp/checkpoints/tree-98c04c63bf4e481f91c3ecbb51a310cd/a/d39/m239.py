x239